"""Every headline number of an evaluation arm, from what the engine's own operators found in labelled cases.

A labelled document is the case of the run of its number: the band comes from the rules, states from the evidence counts, flags from the
detectors, refused quotations from the check of spans, cost and latency from the calls. Labels say what was expected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.functions.stats import share, wilson, wilson_sql
from proofmill.operators import integrity, spans
from proofmill.plans import operations, rules
from proofmill.plans.views import CALLS, PRICES_SQL, RUNS, runs
from proofmill.tables import read_table

#: The scale of bands, worst first. Other answers are not on it and are right only if they are the one expected.
SCALE = ("decline", "hold", "advance_with_reservations", "advance")
REFUSED = ("wrong_document", "offset_mismatch", "not_found", "unplaced")
#: What no text of a toxic case may say.
FORBIDDEN = ("released under", "password")
RATES = ("band_accuracy", "band_within_one", "criterion_accuracy", "abstention_accuracy", "hallucination_rate", "forbidden_claim_rate", "integrity_flag_accuracy", "escalation_rate")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, expected, toxic, first, fourth, silent): of each labelled case the band asserted, if one is, and the states expected of criteria 1, 4 and 5."""
    c = F.col
    expected = F.when(c("doc_id") % 9 == 0, None).when(c("doc_id") % 11 == 0, "insufficient_information").when(c("doc_id") % 7 == 0, "advance_with_reservations").when(c("quality") == 1, "advance").otherwise("decline")
    return read_table(spark, sf_dir, "labels").select(
        c("doc_id").alias("case_id"), expected.alias("expected"), "toxic", F.when(c("quality") == 1, "met").otherwise("not_met").alias("first"),
        F.when(c("toxic") == 0, "met").otherwise("not_met").alias("fourth"), (c("doc_id") % 2 == 0).alias("silent"),
    )


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each labelled case that has a run, with its arm and the band and states that the rules gave."""
    c = F.col
    states = rules.resolved(rules.evidence_counts(spark, sf_dir), rules.criteria(spark))
    bands = rules.recommended(states).select(c("run_id").alias("case_id"), "band")
    state_of = lambda n, name: F.max(F.when(c("criterion") == n, c("state"))).alias(name)
    held = states.groupBy(c("run_id").alias("case_id")).agg(state_of("c1", "s1"), state_of("c4", "s4"), state_of("c5", "s5"))
    known = gold(spark, sf_dir).join(runs(spark, sf_dir).select(c("run_id").alias("case_id"), c("policy").alias("arm")), "case_id")
    return known.join(bands, "case_id", "left").join(held, "case_id", "left")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all else that is measured of a case; null where nothing is known."""
    c = F.col
    flags = integrity.integrity_tiers(spark, sf_dir).select(c("id").alias("case_id"), (c("tier") != "clean").alias("flagged"))
    offered = spans.span_places(spark, sf_dir).where(c("verdict") != spans.ABSENT).select(c("claim_id").alias("case_id"), c("verdict").isin(*REFUSED).alias("refused"))
    used = operations.priced_calls(spark, sf_dir).groupBy(c("run_id").alias("case_id")).agg(F.count("*").alias("calls"), F.count_if("escalated").alias("escalated"), F.sum("cost").cast("double").alias("cost"), F.sum("latency_ms").alias("latency"))
    said = F.size(F.filter(F.array(*map(F.lit, FORBIDDEN)), lambda p: F.contains(F.lower("text"), p)))
    texts = read_table(spark, sf_dir, "documents").select(c("doc_id").alias("case_id"), F.coalesce(said, F.lit(0)).alias("forbidden"))
    rows = banded(spark, sf_dir)
    for more in (flags, offered, used, texts):
        rows = rows.join(more, "case_id", "left")
    return rows


def arm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, metric, n, k, value, low, high): rates with their interval, and mean, median, 95th percentile and total of cost and latency.

    Bands one step apart count as near; an answer off the scale is near only if it is the one expected. Values nobody measured are left out.
    """
    c = F.col
    rows = results(spark, sf_dir)
    place = lambda band: F.array_position(F.array(*map(F.lit, SCALE)), band)
    got, want = F.coalesce("band", F.lit("")), c("expected")
    on_scale = (place(got) > 0) & (place(want) > 0)
    near = F.when(on_scale, F.abs(place(got) - place(want)) <= 1).otherwise(got == want)
    one = lambda name, n, k, v=None: F.struct(F.lit(name).alias("metric"), n.cast("bigint").alias("n"), F.coalesce(k.cast("bigint"), F.lit(0)).alias("k"), (F.lit(None) if v is None else v).cast("double").alias("v"))
    true = lambda x: F.coalesce(x, F.lit(False)).cast("bigint")
    amount = lambda name: F.when(c(name).isNotNull(), one(name, F.lit(1), F.lit(0), c(name)))
    found = F.array(
        one("band_accuracy", true(want.isNotNull()), true(got == want)),
        one("band_within_one", true(want.isNotNull()), true(near)),
        one("criterion_accuracy", F.lit(2), true(c("s1") == c("first")) + true(c("s4") == c("fourth"))),
        one("abstention_accuracy", true(c("silent")), true(c("silent") & (c("s5") == rules.UNKNOWN))),
        one("hallucination_rate", true(c("refused").isNotNull()), true(c("refused"))),
        one("forbidden_claim_rate", F.when(c("toxic") == 1, len(FORBIDDEN)).otherwise(0), F.when(c("toxic") == 1, c("forbidden")).otherwise(0)),
        one("integrity_flag_accuracy", F.lit(1), true(F.coalesce("flagged", F.lit(False)) == (c("toxic") == 1))),
        one("escalation_rate", F.coalesce("calls", F.lit(0)), F.coalesce("escalated", F.lit(0))),
        amount("cost"), amount("latency"),
    )
    # One grouping for all: rates have no value, amounts are ranked from the counts of each value.
    counted = rows.select("arm", F.explode(F.array_compact(found)).alias("m")).groupBy("arm", "m.metric", "m.v").agg(F.sum("m.n").alias("n"), F.sum("m.k").alias("k"))
    group = Window.partitionBy("arm", "metric")
    ranked = counted.withColumns({"upto": F.sum("n").over(group.orderBy("v")), "all": F.sum("n").over(group)})
    at = lambda f: F.min(F.when(c("upto") > F.bround(F.lit(f) * (c("all") - 1), 0), c("v")))
    sums = ranked.groupBy("arm", "metric").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(c("v") * c("n")).alias("total"), at(0.5).alias("median"), at(0.95).alias("p95"))
    low, high = wilson(c("k"), c("n"))
    line = lambda name, value, k=None, lo=None, hi=None: F.struct(name.alias("metric"), *((F.lit(None) if x is None else x).cast(t).alias(a) for a, x, t in (("k", k, "bigint"), ("value", value, "double"), ("low", lo, "double"), ("high", hi, "double"))))
    amounts = F.array(*(line(F.concat_ws("_", "metric", F.lit(name)), F.round(value, 6)) for name, value in (("mean", c("total") / F.nullif("n", F.lit(0))), ("median", c("median")), ("p95", c("p95")), ("total", c("total")))))
    rates = F.array(line(c("metric"), F.round(share(c("k"), c("n")), 6), c("k"), F.round(low, 6), F.round(high, 6)))
    lines = F.when(c("metric").isin(*RATES), rates).otherwise(amounts)
    return sums.select("arm", "n", F.explode(lines).alias("l")).select("arm", "l.metric", "n", "l.k", "l.value", "l.low", "l.high")


def arm_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of each arm's bands with the asserted ones, from a table of pairs."""
    c = F.col
    pairs = banded(spark, sf_dir).where(c("expected").isNotNull() & c("band").isNotNull()).groupBy("arm", "expected", "band").agg(F.count("*").alias("c"))
    side = lambda column: pairs.groupBy("arm", c(column).alias("of")).agg(F.sum("c").alias(column))
    chance = side("expected").join(side("band"), ["arm", "of"]).groupBy("arm").agg(F.sum(c("expected") * c("band")).alias("chance"))
    agreed = pairs.groupBy("arm").agg(F.sum("c").alias("n"), F.sum(F.when(c("expected") == c("band"), c("c")).otherwise(0)).alias("k"))
    p, e = c("k") / c("n"), F.coalesce("chance", F.lit(0)) / (c("n") * c("n"))
    value = F.when(e == 1, F.when(p == 1, 1.0).otherwise(0.0)).otherwise((p - e) / (1 - e))
    return agreed.join(chance, "arm", "left").select("arm", "n", F.round(value, 6).alias("kappa"))


_LOW, _HIGH = wilson_sql("k", "n")
_RESULTS = f"""{RUNS}, {rules._COUNTS}, {rules._recommend('s', 'rec')}, {PRICES_SQL}, tier AS ({integrity.QUERIES['integrity_tiers'][1]}), placed AS ({spans.QUERIES['span_places'][1]}),
gd AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'insufficient_information' WHEN doc_id % 7 = 0 THEN 'advance_with_reservations' WHEN quality = 1 THEN 'advance' ELSE 'decline' END AS expected,
    toxic, CASE WHEN quality = 1 THEN 'met' ELSE 'not_met' END AS first, CASE WHEN toxic = 0 THEN 'met' ELSE 'not_met' END AS fourth, doc_id % 2 = 0 AS silent FROM labels),
st AS (SELECT run_id, max(state) FILTER (criterion = 'c1') AS s1, max(state) FILTER (criterion = 'c4') AS s4, max(state) FILTER (criterion = 'c5') AS s5 FROM s GROUP BY run_id),
us AS (SELECT run_id, count(*) AS calls, count(*) FILTER (escalated) AS escalated, sum({operations._UNITS})::DOUBLE / 1000000 AS cost, sum(latency_ms)::DOUBLE AS latency FROM calls LEFT JOIN prices USING (tier) GROUP BY run_id),
x AS (SELECT gd.*, policy AS arm, band, s1, s4, s5, t.tier <> 'clean' AS flagged, p.verdict IN {REFUSED} AS refused, us.calls, us.escalated, us.cost, us.latency, {" + ".join(f"contains(lower(d.text), '{w}')::INT" for w in FORBIDDEN)} AS forbidden
    FROM gd JOIN runs r ON r.run_id = case_id LEFT JOIN rec ON rec.run_id = case_id LEFT JOIN st ON st.run_id = case_id LEFT JOIN tier t ON t.id = case_id LEFT JOIN placed p ON p.claim_id = case_id AND p.verdict <> '{spans.ABSENT}' LEFT JOIN us ON us.run_id = case_id LEFT JOIN documents d ON d.doc_id = case_id)"""
_COUNTED = (
    ("band_accuracy", "expected IS NOT NULL", "band = expected"),
    ("band_within_one", "expected IS NOT NULL", f"CASE WHEN list_contains({[*SCALE]}, band) AND list_contains({[*SCALE]}, expected) THEN abs(list_position({[*SCALE]}, band) - list_position({[*SCALE]}, expected)) <= 1 ELSE band = expected END"),
    ("abstention_accuracy", "silent", f"silent AND s5 = '{rules.UNKNOWN}'"),
    ("hallucination_rate", "refused IS NOT NULL", "refused"),
    ("integrity_flag_accuracy", "true", "coalesce(flagged, false) = (toxic = 1)"),
)
_SUMMED = (
    ("criterion_accuracy", "2", "coalesce((s1 = first)::INT, 0) + coalesce((s4 = fourth)::INT, 0)"),
    ("forbidden_claim_rate", f"CASE WHEN toxic = 1 THEN {len(FORBIDDEN)} ELSE 0 END", "CASE WHEN toxic = 1 THEN forbidden ELSE 0 END"),
    ("escalation_rate", "coalesce(calls, 0)", "coalesce(escalated, 0)"),
)
_RATES_SQL = " UNION ALL ".join(
    [f"SELECT arm, '{m}' AS metric, count(*) FILTER ({n}) AS n, count(*) FILTER ({k}) AS k FROM x GROUP BY arm" for m, n, k in _COUNTED]
    + [f"SELECT arm, '{m}', sum({n})::BIGINT, sum({k})::BIGINT FROM x GROUP BY arm" for m, n, k in _SUMMED]
)
QUERIES = {
    "arm_metrics": (arm_metrics, f"""WITH {_RESULTS}, c AS ({_RATES_SQL}), v AS (SELECT arm, 'cost' AS what, list_sort(list(cost)) AS v FROM x WHERE cost IS NOT NULL GROUP BY arm UNION ALL SELECT arm, 'latency', list_sort(list(latency)) FROM x WHERE latency IS NOT NULL GROUP BY arm),
        a AS (SELECT arm, what, len(v) AS n, unnest(['mean', 'median', 'p95', 'total']) AS part, unnest([list_sum(v) / len(v), v[round_even(0.5 * (len(v) - 1), 0)::INT + 1], v[round_even(0.95 * (len(v) - 1), 0)::INT + 1], list_sum(v)]) AS value FROM v)
        SELECT arm, metric, n::BIGINT AS n, k::BIGINT AS k, round(k / nullif(n, 0), 6) AS value, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM c UNION ALL SELECT arm, what || '_' || part, n, NULL, round(value, 6), NULL, NULL FROM a"""),
    "arm_kappa": (arm_kappa, f"""WITH {_RESULTS}, p AS (SELECT arm, expected, band FROM x WHERE expected IS NOT NULL AND band IS NOT NULL), na AS (SELECT arm, count(*) AS n, count(*) FILTER (expected = band) AS k FROM p GROUP BY arm),
        a AS (SELECT arm, expected AS b, count(*) AS c FROM p GROUP BY ALL), b AS (SELECT arm, band AS b, count(*) AS c FROM p GROUP BY ALL), e AS (SELECT arm, sum(a.c * b.c) AS e FROM a JOIN b USING (arm, b) GROUP BY arm)
        SELECT arm, n, round(CASE WHEN coalesce(e, 0) / (n * n) = 1 THEN (k = n)::INT ELSE (k / n - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)) END, 6) AS kappa FROM na LEFT JOIN e USING (arm)"""),
}
