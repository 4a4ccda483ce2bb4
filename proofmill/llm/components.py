"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a join and an aggregation by node; nothing is gathered in one task. The links of a step are written
to the shared folder, so the plan stays short and a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm import scratch


def _links(a, b) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each id that ``links`` (a, b) names; component is the smallest id that it reaches.

    Direction, repetition and order of the links don't matter; rows with a null and links to itself are ignored.
    """
    now = scratch.materialize(links.where(F.col("a") != F.col("b")).select(*_links(F.col("a"), F.col("b"))).distinct(), "links-0")
    state, step = _state(now), 0
    while state[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(*_links(F.col("v"), F.col("m")))
        step += 1
        now = scratch.materialize(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), f"links-{step}")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots.select("id", F.col("id").alias("component")))
