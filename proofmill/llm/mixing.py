"""Mixing sources to target weights by pivotal dependent rounding.

Each document gets an expected number of copies, its source's target over its source's size. The whole part is
certain; the fractions are rounded in pairs: words move from one document's expectation to another's until one
of the two is whole. Each move keeps the pair's expected words, and its direction is drawn so that each
document keeps its expectation. A task rounds a bounded group and leaves one fraction at most; those
residuals meet in a tree of the same step, ``FAN_IN`` groups to one, until each source has none.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm import scratch
from proofmill.llm.words import split_words

WEIGHTS = (5, 2, 1)
CEILING = 3
GAP = r"[\x20\x09-\x0D]+"
#: Documents of one source that one group rounds, on average, and groups whose residuals meet in one.
GROUP_ROWS, FAN_IN = 4096, 64
_ROWS = "id bigint, source string, size bigint, whole bigint, part double, draw bigint, bucket bigint, done boolean"


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, n_docs, target) of (source, source_size, n_docs): one row for each source.

    Sources ordered by code point, null last, get ``weights`` in turn. The targets share the sum of all sizes by
    weight; a target stops at ``ceiling`` times its source's size and its excess is reshared by weight among the
    others until none is above. That is the level at which sources ordered by size over weight stop being full.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    every, by_fill = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = totals.withColumn("weight", weight).select(
        "source", "source_size", "n_docs", "weight",
        F.row_number().over(by_fill).alias("place"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum(ceiling * F.col("source_size")).over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    share = F.col("left_words").cast("double") * F.col("weight") / F.col("left_weight")
    level = F.min(F.when(share <= ceiling * F.col("source_size"), F.struct("place", "left_words", "left_weight"))).over(every)
    full = ceiling * F.col("source_size").cast("double")
    return ranked.withColumn("level", level).select(
        "source", "source_size", "n_docs",
        F.when(F.col("place") < F.col("level.place"), full)
        .when(F.col("level").isNull(), full)
        .otherwise(F.col("level.left_words").cast("double") * F.col("weight") / F.col("level.left_weight")).alias("target"),
    )


def _uniform(draws: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit draws: other ones at each level of the tree."""
    x = draws.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(step + 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivotal_round(sizes: list[int], parts: list[float], draws: list[float], last: bool) -> tuple[list[float], int | None]:
    """Round ``parts`` to 0 or 1 pair by pair; returns them and the place of the one that stays a fraction.

    Words (size times part) are what a pair exchanges, so their sum never changes. With ``last`` the one left
    over is rounded by its own draw.
    """
    parts, held = list(parts), None
    for j in range(len(parts)):
        if held is None:
            held = j
        else:
            i = held
            up = min((1 - parts[i]) * sizes[i], parts[j] * sizes[j])
            down = min(parts[i] * sizes[i], (1 - parts[j]) * sizes[j])
            move = up if draws[j] * (up + down) < down else -down
            parts[i] += move / sizes[i]
            parts[j] -= move / sizes[j]
            for k in (i, j):
                parts[k] = float(round(parts[k])) if abs(parts[k] - round(parts[k])) < 1e-9 else parts[k]
            held = next((k for k in (i, j) if 0 < parts[k] < 1), None)
    if last and held is not None:
        parts[held] = float(draws[held] < parts[held])
        held = None
    return parts, held


def _rounded(rows: DataFrame, step: int) -> DataFrame:
    """One level of the tree. A group without ``FAN_IN`` siblings left (its source has one bucket) is rounded to the end."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "draw", "id"], kind="stable")
        parts, held = pivotal_round(rows["size"].tolist(), rows["part"].tolist(), _uniform(rows["draw"].to_numpy(), step).tolist(), bool(rows["last"].iloc[0]))
        rows["part"], rows["done"] = parts, True
        if held is not None:
            rows.iloc[held, rows.columns.get_loc("done")] = False
        return rows[["id", "source", "size", "whole", "part", "draw", "bucket", "done", "buckets"]]

    return rows.withColumn("last", F.col("buckets") == 1).groupBy("source", "bucket").applyInPandas(run, f"{_ROWS}, buckets bigint")


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``nth``, which tells rows equal in (drawn, source, size) apart, to written rows with ``pid``, the task that wrote each.

    Rows are counted by key and task first, so a group of copies of any size is numbered by as many tasks as wrote it.
    """
    key = ["drawn", "source", "size"]
    counts = rows.groupBy(*key, "pid").agg(F.count("*").alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy(*key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    repeated = counts.groupBy(*key).agg(F.sum("many").alias("all")).where(F.col("all") > 1)
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in key))
    offsets = counts.withColumn("before", before)
    again = offsets.join(repeated.select(*key), same(offsets, repeated), "left_semi").select(*(F.col(c).alias(f"{c}_of") for c in [*key, "pid"]), "before")
    is_again = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in [*key, "pid"]))
    joined = rows.join(again, is_again, "left")
    nth = F.row_number().over(Window.partitionBy(*key, "pid").orderBy("id")) - 1
    single = joined.where(F.col("before").isNull()).withColumn("nth", F.lit(0).cast("long"))
    several = joined.where(F.col("before").isNotNull()).withColumn("nth", F.col("before") + nth)
    return single.unionByName(several).select("id", "drawn", "source", "size", "nth")


def mix_sources(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, draw_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, taken, copies), one row for each row of ``docs``.

    ``docs`` has ``id_col``, ``text`` and ``source``; other columns are ignored. Null text has size 0; documents of
    size 0 are never copied; null sources are one source, last in order. Repeated rows, and rows with a null id, are
    rounded apart from each other; rows equal in id, source and size are interchangeable. An empty table gives no rows,
    and an empty corpus targets of 0. The draws hash ``seed``, ``draw_col`` (the id), the size and a number among equal
    rows, so reruns agree however the rows are partitioned. The sources themselves, a row for each, are ordered in one task.
    """
    spark = docs.sparkSession
    size = F.size(split_words(F.coalesce(F.col("text"), F.lit("")), GAP)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(draw_col or id_col).cast("long").alias("drawn"), "source", size.alias("size"), F.spark_partition_id().alias("pid"))
    sizes = scratch.materialize(rows, "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = scratch.materialize(source_targets(totals, weights, ceiling), "targets")
    of = targets.select(F.col("source").alias("its"), "source_size", "n_docs", "target")
    copies = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.xxhash64(F.lit(seed), F.col("drawn"), F.col("size"), F.col("nth"))
    buckets = F.ceil(F.col("n_docs") / GROUP_ROWS)
    spread = numbered(sizes).join(of, F.col("source").eqNullSafe(F.col("its"))).withColumns({"copies": copies, "draw": draw, "buckets": buckets})
    spread = spread.select(
        "id", "source", "size", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("part"),
        "draw", F.pmod(F.xxhash64("draw"), F.col("buckets")).alias("bucket"), "buckets",
    )
    split = F.col("part") > 0
    decided = [spread.where(~split).select("id", "source", "size", "whole", "part")]
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    groups, level, rows = -(-most // GROUP_ROWS), 0, spread.where(split)
    while groups:
        out = scratch.materialize(_rounded(rows, level), f"level-{level}")
        decided.append(out.where("done").select("id", "source", "size", "whole", "part"))
        fan = F.lit(FAN_IN)
        rows = out.where(~F.col("done")).drop("done").withColumns({"bucket": F.floor(F.col("bucket") / fan), "buckets": F.ceil(F.col("buckets") / fan)})
        groups, level = 0 if groups == 1 else -(-groups // FAN_IN), level + 1
    rounded = reduce(DataFrame.unionByName, decided)
    got = F.col("whole") + F.col("part").cast("long")
    return rounded.join(of, F.col("source").eqNullSafe(F.col("its"))).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", (got * F.col("size")).alias("taken"), got.alias("copies")
    )
