"""Deletion that reaches the tables which depend on what goes, and key-value rows with delete markers.

Files are immutable, so deleting is rewriting: only the partitions that hold a row to delete are read and overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.plans import operations
from proofmill.plans.views import AS_OF_RUNS, CALLS, EVENTS, RUNS, calls, run_events, runs


@dataclass(frozen=True)
class Child:
    """A table whose rows go with those of ``parent`` that they refer to by ``column``; its own key is ``key``."""

    table: str
    column: str
    parent: str
    key: str


def cascade(tables: dict[str, DataFrame], root: str, key: str, gone: DataFrame, children: list[Child]) -> dict[str, DataFrame]:
    """For each table the keys of its rows that go: those of ``gone`` (key) in ``root``, then rows that refer to one that goes, in order.

    A child may be the parent of later ones. Null references refer to nothing.
    """
    lost = {root: tables[root].join(gone.select(key).distinct(), key, "left_semi").select(key)}
    keys = {root: key}
    for child in children:
        parents = lost[child.parent].select(F.col(keys[child.parent]).alias(child.column)).distinct()
        lost[child.table] = tables[child.table].join(parents, child.column, "left_semi").select(child.key)
        keys[child.table] = child.key
    return lost


def rewrite(spark: SparkSession, path: str, key: str, lost: DataFrame, partition: str) -> tuple[int, int]:
    """Delete the rows of the table at ``path``, partitioned by ``partition``, whose ``key`` is in ``lost``; returns partitions rewritten and dropped.

    What stays of the partitions concerned is written beside the table first and moved in from there, so no file is read while it is
    overwritten and a call that was cut off can be made again. A partition of which nothing stays is dropped.
    """
    table = spark.read.parquet(path)
    keys = lost.select(key).distinct()
    touched = table.join(keys, key, "left_semi").select(partition).distinct()
    staged = f"{path.rstrip('/')}.staged"
    kept = table.join(F.broadcast(touched), table[partition].eqNullSafe(touched[partition]), "left_semi").join(keys, key, "left_anti")
    before = {r[partition] for r in touched.collect()}
    if not before:
        return 0, 0
    kept.write.mode("overwrite").partitionBy(partition).parquet(staged)
    stays = spark.read.schema(table.schema).parquet(staged)
    stays.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    left = {r[partition] for r in stays.select(partition).distinct().collect()}
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for value in before - left:
        name = "__HIVE_DEFAULT_PARTITION__" if value is None else value
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={name}"), True)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
    spark.catalog.refreshByPath(path)
    return len(before & left), len(before - left)


def current(rows: DataFrame, key: str, order: list[str], deleted: Column) -> DataFrame:
    """Of append-only rows the last of each key, without the keys whose last row is a delete marker; a key set again after one is back."""
    names = [c for c in rows.columns if c != key]
    last = rows.withColumn("_gone", deleted).groupBy(key).agg(F.max_by(F.struct(*names, "_gone"), F.struct(*order)).alias("r"))
    return last.where(~F.coalesce("r._gone", F.lit(False))).select(key, *(f"r.{c}" for c in names))


def retention(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, str]]:
    """The tables of the ledger, the keys that a retention of five years deletes from each, and the names of the keys."""
    tables = {
        "runs": runs(spark, sf_dir),
        "calls": calls(spark, sf_dir).withColumn("call_id", F.struct("run_id", "call_no")),
        "events": run_events(spark, sf_dir),
    }
    cutoff = F.lit(AS_OF_RUNS).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(5 * operations.WINDOW_DAYS))
    gone = tables["runs"].where(F.col("finished_at") < cutoff)
    lost = cascade(tables, "runs", "run_id", gone, [Child("calls", "run_id", "runs", "call_id"), Child("events", "run_id", "runs", "event_id")])
    return tables, lost, {"runs": "run_id", "calls": "call_id", "events": "event_id"}


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table before and after a retention of five years, with a sum of the runs of those that stay."""
    tables, lost, keys = retention(spark, sf_dir)
    parts = []
    for name, table in tables.items():
        key = keys[name]
        gone = lost[name].distinct().withColumn("_gone", F.lit(True))
        marked = table.select("run_id", key) if key != "run_id" else table.select("run_id")
        marked = marked.join(gone, key, "left")
        parts.append(marked.agg(F.lit(name).alias("table"), F.count("*").alias("n_before"), F.count_if(F.col("_gone").isNull()).alias("n_after"), F.coalesce(F.sum(F.when(F.col("_gone").isNull(), F.col("run_id"))), F.lit(0)).alias("runs_after")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of runs as they stand: an error event deletes the setting of its run and hour, any other sets it."""
    c = F.col
    log = run_events(spark, sf_dir).select(F.concat_ws("/", "run_id", F.hour("happened") % 2).alias("name"), "happened", "event_id", "kind", "value")
    return current(log, "name", ["happened", "event_id"], c("kind") == "error").select("name", "kind", "event_id")


_GONE = f"g AS (SELECT run_id FROM runs WHERE finished_at < TIMESTAMP '{AS_OF_RUNS}' - INTERVAL {5 * operations.WINDOW_DAYS} DAY)"
QUERIES = {
    "retained": (retained, f"""WITH {RUNS}, {CALLS}, {EVENTS}, {_GONE}, t AS (SELECT 'runs' AS "table", run_id FROM runs UNION ALL SELECT 'calls', run_id FROM calls UNION ALL SELECT 'events', run_id FROM run_events)
        SELECT "table", count(*) AS n_before, count(*) FILTER (g.run_id IS NULL) AS n_after, coalesce(sum(t.run_id) FILTER (g.run_id IS NULL), 0)::BIGINT AS runs_after FROM t LEFT JOIN g ON g.run_id = t.run_id GROUP BY 1"""),
    "settings": (settings, f"""WITH {EVENTS}, l AS (SELECT run_id || '/' || hour(happened) % 2 AS name, kind, event_id FROM run_events QUALIFY row_number() OVER (PARTITION BY name ORDER BY happened DESC, event_id DESC) = 1)
        SELECT name, kind, event_id FROM l WHERE kind IS DISTINCT FROM 'error'"""),
}
