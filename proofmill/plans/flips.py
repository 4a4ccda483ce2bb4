"""Flips between repeated runs, counted from contingencies: pairs of a base are never made, whatever their number.

Of m runs of a base m(m-1)/2 pairs are compared. Two runs of a pair agree if they are in one cell, so the pairs that agree follow from the
sizes of the cells; a state that one side lacks is a value of its own, and what both sides lack is not compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.functions.stats import wilson, wilson_sql
from proofmill.plans import rules
from proofmill.plans.views import RUNS, runs

#: Repeats of one case that make a control.
CONTROL_RUNS = 3
_BASE = ["label", "control", "base"]


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("bigint")


def band_flips(outcomes: DataFrame) -> DataFrame:
    """(label, control, n, k): pairs of runs (label, control, base, band) of one base, and those of different bands; no band is a band."""
    cells = outcomes.groupBy(*_BASE, "band").agg(F.count("*").alias("c"))
    bases = cells.groupBy(*_BASE).agg(F.sum("c").alias("m"), F.sum(_pairs(F.col("c"))).alias("same"))
    return bases.groupBy("label", "control").agg(F.sum(_pairs(F.col("m"))).alias("n"), F.sum(_pairs(F.col("m")) - F.col("same")).alias("k"))


def criterion_flips(outcomes: DataFrame, states: DataFrame) -> DataFrame:
    """(label, control, n, k): over pairs the criteria that either run has a state for, and those whose states differ; ``states`` has (label, control, base, criterion, state)."""
    sizes = outcomes.groupBy(*_BASE).agg(F.count("*").alias("m"))
    cells = states.groupBy(*_BASE, "criterion", "state").agg(F.count("*").alias("c"))
    known = cells.groupBy(*_BASE, "criterion").agg(F.sum("c").alias("p"), F.sum(_pairs(F.col("c"))).alias("same")).join(sizes, _BASE)
    compared = _pairs(F.col("m")) - _pairs(F.col("m") - F.col("p"))
    return known.groupBy("label", "control").agg(F.sum(compared).alias("n"), F.sum(compared - F.col("same")).alias("k"))


def score_deltas(outcomes: DataFrame) -> DataFrame:
    """(label, control, n, total, largest): over pairs with two scores the sum and the greatest of their distances.

    A score stands above those before it and below those behind it, so sums over pairs follow from ranks of the distinct scores.
    """
    cells = outcomes.where(F.col("score").isNotNull()).groupBy(*_BASE, "score").agg(F.count("*").alias("c"))
    up, every = Window.partitionBy(*_BASE).orderBy("score"), Window.partitionBy(*_BASE)
    ranked = cells.withColumns({"upto": F.sum("c").over(up), "m": F.sum("c").over(every)})
    before, behind = F.col("upto") - F.col("c"), F.col("m") - F.col("upto")
    bases = ranked.groupBy(*_BASE).agg(F.max("m").alias("m"), F.sum(F.col("score") * F.col("c") * (before - behind)).alias("total"), (F.max("score") - F.min("score")).alias("spread"))
    return bases.groupBy("label", "control").agg(F.sum(_pairs(F.col("m"))).alias("n"), F.sum("total").alias("total"), F.max(F.when(F.col("m") > 1, F.col("spread"))).alias("largest"))


def repeated_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes and known states of all runs: a policy's runs of one candidate are repeats of a base, the first three of them its control."""
    resolved = rules.resolved(rules.evidence_counts(spark, sf_dir), rules.criteria(spark))
    known = runs(spark, sf_dir).select("run_id", F.col("policy").alias("label"), F.col("candidate").alias("base"))
    nth = F.row_number().over(Window.partitionBy("label", "base").orderBy("run_id"))
    judged = known.join(rules.recommended(resolved).select("run_id", "band", "score"), "run_id").withColumn("nth", nth)
    arms = F.explode(F.when(F.col("nth") <= CONTROL_RUNS, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("control")
    outcomes = judged.select("run_id", "label", "base", "band", "score", arms)
    states = resolved.where(F.col("state") != rules.UNKNOWN).select("run_id", "criterion", "state").join(outcomes.select("run_id", *_BASE), "run_id")
    return outcomes, states


def flip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By policy, and for its control, flips of bands and of criteria with intervals, and mean and largest distance of scores."""
    outcomes, states = repeated_runs(spark, sf_dir)
    keys = ["label", "control"]
    of = lambda rows, name: rows.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in keys))
    joined = of(band_flips(outcomes), "band").join(of(criterion_flips(outcomes, states), "criterion"), keys, "left").join(of(score_deltas(outcomes), "score"), keys, "left")
    c = F.col
    low, high = wilson(c("band_k"), c("band_n"))
    return joined.select(
        *keys, c("band_n").alias("pairs"), c("band_k").alias("band_flips"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), c("criterion_n").alias("criteria"),
        c("criterion_k").alias("criterion_flips"), F.round(c("score_total") / F.nullif("score_n", F.lit(0)), 6).alias("mean_delta"), F.round("score_largest", 6).alias("largest_delta"),
    )


_LOW, _HIGH = wilson_sql("k", "n")
QUERIES = {
    "flip_summary": (flip_summary, f"""WITH {RUNS}, {rules._COUNTS}, {rules._recommend('s', 'rec')}, a AS (SELECT u.run_id, policy AS label, candidate AS base, band, score, row_number() OVER (PARTITION BY policy, candidate ORDER BY u.run_id) AS nth FROM runs u JOIN rec ON rec.run_id = u.run_id),
        oc AS (SELECT *, false AS control FROM a UNION ALL SELECT *, true FROM a WHERE nth <= {CONTROL_RUNS}),
        pr AS (SELECT x.label, x.control, x.run_id AS i, y.run_id AS j, x.band AS b1, y.band AS b2, x.score AS s1, y.score AS s2 FROM oc x JOIN oc y ON x.label = y.label AND x.base = y.base AND x.control = y.control AND x.run_id < y.run_id),
        bf AS (SELECT label, control, count(*) AS n, count(*) FILTER (b1 IS DISTINCT FROM b2) AS k, avg(abs(s1 - s2)) AS mean_delta, max(abs(s1 - s2)) AS largest FROM pr GROUP BY ALL),
        st AS (SELECT run_id, criterion, state FROM s WHERE state <> '{rules.UNKNOWN}'), kc AS (SELECT label, control, i, j, criterion FROM pr JOIN st ON run_id = i UNION SELECT label, control, i, j, criterion FROM pr JOIN st ON run_id = j),
        cf AS (SELECT label, control, count(*) AS nc, count(*) FILTER (p.state IS DISTINCT FROM q.state) AS kc FROM kc LEFT JOIN st p ON p.run_id = i AND p.criterion = kc.criterion LEFT JOIN st q ON q.run_id = j AND q.criterion = kc.criterion GROUP BY ALL),
        g AS (SELECT DISTINCT label, control FROM oc)
        SELECT g.label, g.control, coalesce(n, 0)::BIGINT AS pairs, coalesce(k, 0)::BIGINT AS band_flips, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high, coalesce(nc, 0)::BIGINT AS criteria, coalesce(kc, 0)::BIGINT AS criterion_flips,
            round(mean_delta, 6) AS mean_delta, round(largest, 6) AS largest_delta FROM g LEFT JOIN bf USING (label, control) LEFT JOIN cf USING (label, control)"""),
}
