"""The status machine and the budget of each run over a stream of its events, with state and timers; and the same over a finished log.

State of a run is its last status, what it has spent, whether its ceiling is behind it, and when it was last heard of. A timer of event time
closes a run that was idle too long. The store of the state has to be RocksDB: ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from proofmill.plans import rules

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a run may spend, and the hours after which it counts as idle.
CEILING, IDLE_HOURS = 1000.0, 48
#: What comes out: an illegal move, the event at which the ceiling was reached, or that a run went idle (no event).
ALERT = "run_id bigint, alert string, event_id bigint, src string, dst string, spent double"
_STATE = "status string, spent double, over boolean, heard bigint"
_HOUR_MS = 3_600_000


class RunMachine(StatefulProcessor):
    """One instance for each task; runs are its keys."""

    def __init__(self, ceiling: float = CEILING, idle_hours: int = IDLE_HOURS):
        self.ceiling, self.idle_ms = ceiling, idle_hours * _HOUR_MS
        self.legal, self.kinds = set(rules.EDGE_ROWS), dict(rules.KINDS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A batch's events of one run, taken by time, then id."""
        events = pd.concat(list(rows)).sort_values(["happened", "event_id"])
        status, spent, over, heard = self.run.get() if self.run.exists() else (None, 0.0, False, 0)
        out = []
        for happened, event_id, kind, value in zip(events["happened"], events["event_id"], events["kind"], events["value"]):
            now = self.kinds.get(kind)
            if status is not None and now is not None and now != status and (status, now) not in self.legal:
                out.append((key[0], "illegal", event_id, status, now, None))
            status = now if now is not None else status
            spent += 0.0 if pd.isna(value) else float(value)
            if not over and spent >= self.ceiling:
                over = True
                out.append((key[0], "ceiling", event_id, None, None, spent))
            heard = max(heard, int(happened.timestamp() * 1000))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(heard + self.idle_ms)
        self.run.update((status, spent, over, heard))
        yield self.alerts(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing was heard of a run for too long; it is reported once and forgotten when it is heard of again."""
        status, spent, _, _ = self.run.get()
        yield self.alerts([(key[0], "idle", None, status, None, spent)])

    def alerts(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in ALERT.split(", ")])
        return frame.astype({"run_id": "int64", "event_id": "Int64", "spent": "float64"})

    def close(self) -> None:
        pass


def machine_alerts(events: DataFrame, ceiling: float = CEILING, idle_hours: int = IDLE_HOURS, late: str = "1 hour") -> DataFrame:
    """Alerts over a stream of events (run_id, event_id, happened timestamp, kind, value); events of a run come in order from batch to batch."""
    keyed = events.withWatermark("happened", late).groupBy("run_id")
    return keyed.transformWithStateInPandas(RunMachine(ceiling, idle_hours), ALERT, "Append", "EventTime")


def logged_alerts(events: DataFrame, ceiling: float = CEILING) -> DataFrame:
    """The same illegal moves and ceilings over a finished log, by windows. Whether a run is idle depends on when one asks, so idle ones are left out."""
    status = F.element_at(F.create_map(*(F.lit(x) for pair in rules.KINDS.items() for x in pair)), F.col("kind"))
    order = Window.partitionBy("run_id").orderBy("happened", "event_id")
    spent = F.sum(F.coalesce("value", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(status, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.select("run_id", "event_id", before.alias("src"), status.alias("dst"), spent.alias("spent"), F.coalesce("value", F.lit(0.0)).alias("value"))
    moves = rows.where(F.col("src") != F.col("dst")).join(F.broadcast(rules.edges(events.sparkSession)), ["src", "dst"], "left_anti")
    illegal = moves.select("run_id", F.lit("illegal").alias("alert"), "event_id", "src", "dst", F.lit(None).cast("double").alias("spent"))
    over = rows.where((F.col("spent") >= ceiling) & (F.col("spent") - F.col("value") < ceiling)).groupBy("run_id").agg(F.min(F.struct("spent", "event_id")).alias("f"))
    reached = over.select("run_id", F.lit("ceiling").alias("alert"), "f.event_id", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), "f.spent")
    return illegal.unionAll(reached)
