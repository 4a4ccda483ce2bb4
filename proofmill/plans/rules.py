"""From verified evidence to a band: states, score, gates, blockers, reasons, overrides and review.

Criteria are a small table that people write, so it is broadcast; runs are the long side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill import fixtures
from proofmill.operators import integrity
from proofmill.plans.views import CALLS, EVENTS, RUNS, calls, run_events, runs

CRITERIA_SCHEMA = "ord int, criterion string, kind string, weight int, min_supported int, met double, partial double"
CRITERIA = [
    (1, "c1", "standard", 4, 1, 1.0, 0.5), (2, "c2", "high_stakes", 6, 2, 1.0, 0.5), (3, "c3", "blocker", 3, 1, 1.0, 0.5),
    (4, "c4", "standard", 2, 1, 1.0, 0.25), (5, "c5", "blocker", 1, 1, 1.0, 0.5),
]
MIN_COVERAGE = 0.5
#: Tasks for each core by which runs are dealt.
TASKS_A_CORE = 8
#: Bands by least score, best first.
BANDS = ((0.75, "advance"), (0.4, "hold"), (0.0, "decline"))
UNKNOWN = "insufficient_evidence"


def criteria(spark: SparkSession) -> DataFrame:
    return fixtures.frame(spark, CRITERIA_SCHEMA, CRITERIA)


def dealt(frame: DataFrame) -> DataFrame:
    """Rows dealt by run to a stated number of tasks, none of which gets larger because small shuffled files were put together; frames dealt alike are joined where they are."""
    return frame.repartition(TASKS_A_CORE * frame.sparkSession.sparkContext.defaultParallelism, "run_id")


def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, ord, supported, contradicted, unassessed): what the calls of a run stand for, by criterion.

    Calls are dealt by run once: states, bands and joins by run follow in the same tasks.
    """
    return counted(calls(spark, sf_dir))


def counted(made: DataFrame) -> DataFrame:
    """The same of any calls (run_id, call_no, latency_ms, input_tokens)."""
    used = made.where((F.col("call_no") <= 5)).select("run_id", "call_no", "latency_ms", "input_tokens")
    return dealt(used).groupBy("run_id", F.col("call_no").alias("ord")).agg(
        F.sum(F.when(F.col("latency_ms") % 4 != 0, 1).otherwise(0)).alias("supported"),
        F.sum(F.when(F.col("latency_ms") % 7 == 0, 1).otherwise(0)).alias("contradicted"),
        F.max(F.when(F.col("input_tokens") > 4900, "budget")).alias("unassessed"),
    )


def state_of(supported: Column, contradicted: Column, unassessed: Column, least: Column) -> Column:
    """The state of a criterion, by the first rule that applies."""
    state = F.when(unassessed | ((supported == 0) & ~contradicted), UNKNOWN).when((supported > 0) & contradicted, "contradicted")
    return state.when(supported == 0, "not_met").when(supported >= least, "met").otherwise("partial")


def resolved(counts: DataFrame, rubric: DataFrame) -> DataFrame:
    """A state for every criterion of every run; a criterion without a row has no evidence. First rule that applies.

    A run's rows, at most one a criterion, become a map, in which each criterion is looked up: nothing is joined or shuffled by criterion.
    """
    entry = F.struct(F.col("ord").cast("bigint"), F.struct("supported", "contradicted", "unassessed"))
    held = counts.groupBy("run_id").agg(F.map_from_entries(F.collect_list(entry)).alias("held"))
    # A null run is a run without evidence.
    own = F.when(F.col("run_id").isNotNull(), F.try_element_at("held", F.col("ord").cast("bigint")))
    full = held.crossJoin(F.broadcast(rubric)).withColumn("own", own).select(
        "run_id", *rubric.columns, F.coalesce("own.supported", F.lit(0)).alias("supported"), F.coalesce("own.contradicted", F.lit(0)).alias("contradicted"), "own.unassessed"
    )
    return full.withColumn("state", state_of(F.col("supported"), F.col("contradicted") > 0, F.col("unassessed").isNotNull(), F.col("min_supported")))


def recommended(states: DataFrame) -> DataFrame:
    """Coverage, score, blockers, band and reasons of each run from rows (run_id, ord, kind, weight, met, partial, state, unassessed)."""
    c = F.col
    known, blocker = c("state") != UNKNOWN, c("kind") == "blocker"
    fails, open_ = blocker & c("state").isin("not_met", "contradicted"), blocker & ~known
    points = F.when(c("state") == "met", c("met")).when(c("state") == "partial", c("partial")).otherwise(0.0)
    by_run = states.groupBy("run_id").agg(
        (F.sum(F.when(known, c("weight")).otherwise(0)) / F.sum("weight")).alias("coverage"),
        (F.sum(F.when(known, c("weight") * points)) / F.sum(F.when(known, c("weight")))).alias("earned"),
        F.min(F.when(fails, c("ord"))).alias("failed"),
        F.min(F.when(open_, c("ord"))).alias("asked"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fails | open_, F.struct("ord", "criterion")))), lambda x: x["criterion"]), ",").alias("blockers"),
        F.bool_or(c("state") == "contradicted").alias("conflict"),
        F.bool_or(c("unassessed").isNotNull()).alias("unassessed"),
    )
    return decided(by_run)


def decided(by_run: DataFrame, *more: str) -> DataFrame:
    """Band, score and reasons of each run from rows (run_id, coverage, earned, failed, asked, blockers, conflict, unassessed), and ``more`` columns as they are."""
    c = F.col
    gate = c("earned").isNull() | (c("coverage") < MIN_COVERAGE)
    band = F.when(gate, "insufficient_information").when(c("failed").isNotNull(), "decline").when(c("asked").isNotNull(), "manual_review_required")
    for least, name in BANDS:
        band = band.when(c("earned") >= least, name)
    # The reason of an open blocker stays if it came before the first failure; the gate gives its own reason alone.
    asked_first = c("asked").isNotNull() & (c("failed").isNull() | (c("asked") < c("failed")))
    reasons = F.array_compact(F.array(F.when(asked_first, F.lit("blocker_unknown")), F.when(c("conflict"), F.lit("contradicted_evidence")), F.when(c("unassessed"), F.lit("unassessed_criterion"))))
    score = F.when(~gate & ~band.isin("insufficient_information", "manual_review_required"), c("earned"))
    return by_run.select(
        "run_id", band.alias("band"), F.round(score, 6).alias("score"), F.round("coverage", 6).alias("coverage"),
        F.round("earned", 6).alias("earned"), F.when(gate, "").otherwise(c("blockers")).alias("blockers"), F.when(gate, "low_coverage").otherwise(F.array_join(reasons, ",")).alias("reasons"), *more,
    )


#: What the calls of a run, whatever their number, say of it besides.
MARKS = ("partial_profile", "invalid_span", "budget_capped", "degraded")


def judged(made: DataFrame, rubric: list[tuple] = CRITERIA) -> DataFrame:
    """G10 to G14 of each run of the calls, with ``assessed``, MARKS and ``contradicted``: one row a run from one shuffle of the calls.

    The same as ``recommended(resolved(counted(made), ...))`` where the rubric is known when the plan is made: what each criterion needs
    is a column of one aggregation, so no map is collected and no run multiplied by its criteria. Runs that no call up to the fifth
    belongs to have marks only; ``assessed`` is false there.
    """
    c = F.col
    names = [n.split()[0] for n in CRITERIA_SCHEMA.split(", ")]
    rubric = [dict(zip(names, row, strict=True)) for row in sorted(rubric)]
    some = lambda when: F.coalesce(F.bool_or(when), F.lit(False))
    # A null run is a run without evidence.
    counts = [
        column.alias(f"{name}_{k['ord']}")
        for k in rubric
        for own in [c("run_id").isNotNull() & (c("call_no") == k["ord"])]
        for name, column in (("s", F.count_if(own & (c("latency_ms") % 4 != 0))), ("c", some(own & (c("latency_ms") % 7 == 0))), ("u", some(own & (c("input_tokens") > 4900))))
    ]
    marks = [(F.count("*") < 2).alias("partial_profile"), F.bool_or(c("latency_ms") % 11 == 0).alias("invalid_span"), F.bool_or((c("call_no") <= 5) & (c("input_tokens") > 4900)).alias("budget_capped"), F.bool_or(c("retried") & c("changed")).alias("degraded")]
    by_run = dealt(made.select("run_id", "call_no", "latency_ms", "input_tokens", "retried", "changed")).groupBy("run_id").agg(some(c("call_no") <= 5).alias("assessed"), *marks, *counts)
    states = [state_of(c(f"s_{n}"), c(f"c_{n}"), c(f"u_{n}"), F.lit(k["min_supported"])).alias(f"state_{n}") for k in rubric for n in [k["ord"]]]
    unassessed = F.exists(F.array(*(c(f"u_{k['ord']}") for k in rubric)), lambda x: x)
    full = by_run.select("run_id", "assessed", *MARKS, unassessed.alias("unassessed"), *states)
    state = lambda k: c(f"state_{k['ord']}")
    known = lambda k: state(k) != UNKNOWN
    fails = lambda k: state(k).isin("not_met", "contradicted")
    points = lambda k: F.when(state(k) == "met", k["met"]).when(state(k) == "partial", k["partial"]).otherwise(0.0)
    total = lambda columns: sum(columns, F.lit(0))
    of = lambda when, what: F.array(*(F.when(when(k), F.lit(k[what])) for k in rubric if k["kind"] == "blocker"))
    weight = total(F.when(known(k), k["weight"]).otherwise(0) for k in rubric)
    summed = full.select(
        "run_id", "assessed", *MARKS, "unassessed",
        (weight / sum(k["weight"] for k in rubric)).alias("coverage"),
        (total(F.when(known(k), k["weight"] * points(k)).otherwise(0.0) for k in rubric) / F.nullif(weight, F.lit(0))).alias("earned"),
        F.array_min(of(fails, "ord")).alias("failed"),
        F.array_min(of(lambda k: ~known(k), "ord")).alias("asked"),
        F.array_join(of(lambda k: fails(k) | ~known(k), "criterion"), ",").alias("blockers"),
        F.array_contains(F.array(*map(state, rubric)), "contradicted").alias("conflict"),
    )
    return decided(summed, "assessed", *MARKS, c("conflict").alias("contradicted"))


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10 to G14 for every run."""
    return judged(calls(spark, sf_dir).where(F.col("call_no") <= 5)).drop("assessed", *MARKS, "contradicted")


def overridden(states: DataFrame, overrides: DataFrame) -> DataFrame:
    """A person's state replaces the computed one and counts as assessed."""
    joined = states.join(overrides, ["run_id", "ord"], "left")
    return joined.withColumns({"state": F.coalesce("new_state", "state"), "unassessed": F.when(F.col("new_state").isNull(), F.col("unassessed"))})


def recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How overrides of criterion 2 by every seventh run move bands."""
    states = resolved(evidence_counts(spark, sf_dir), criteria(spark))
    asked = states.where((F.col("run_id") % 7 == 0) & (F.col("ord") == 2)).select("run_id", "ord", F.when(F.col("state") == "met", "not_met").otherwise("met").alias("new_state"))
    before, after = recommended(states).select("run_id", F.col("band").alias("old_band")), recommended(overridden(states, asked)).select("run_id", "band")
    return after.join(before, "run_id").groupBy("old_band", "band").agg(F.count("*").alias("n"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, integrity) of every text that has a finding or none, dealt by run: a run's integrity is that of the text of the same number."""
    c = F.col
    return dealt(integrity.integrity_tiers(spark, sf_dir).select(c("id").alias("run_id"), (c("tier") != "clean").alias("integrity")))


def looked_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommendation of every run, and ``why`` a person has to look at it, in order, each reason once; under the coverage gate that is the only reason.

    What is not known of a run, as it is not among the runs, is no reason. A run of one call has read its candidate in part.
    """
    c = F.col
    own = F.split("reasons", ",")
    kept = lambda name: F.when(F.array_contains(own, name), F.lit(name))
    overlaid = [F.when(c(f) & c("listed") & (c("reasons") != "low_coverage"), F.lit(f)) for f in ("integrity", "invalid_span", "partial_profile", "budget_capped")]
    named = [kept("low_coverage"), kept("blocker_unknown"), kept("contradicted_evidence"), *overlaid, kept("unassessed_criterion")]
    listed = dealt(runs(spark, sf_dir).select("run_id", F.lit(True).alias("listed")))
    rows = judged(calls(spark, sf_dir)).where("assessed").join(listed, "run_id", "left").join(flagged(spark, sf_dir), "run_id", "left")
    return rows.withColumn("why", F.array_join(F.array_compact(F.array(*named)), ","))


def human_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a person has to look at a recommended run."""
    return looked_at(spark, sf_dir).select("run_id", F.col("why").alias("reasons"))


def derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that led to each run's band, numbered: coverage, score, then the gate alone, or blockers, else the band, and why a person is asked."""
    c = F.col
    step = lambda rule, value=None, outcome=None: F.struct(F.lit(rule).alias("rule"), (value if value is not None else F.lit(None)).cast("double").alias("value"), (outcome if outcome is not None else F.lit(None)).cast("string").alias("outcome"))
    gate, blocked = c("band") == "insufficient_information", c("blockers") != ""
    rows = looked_at(spark, sf_dir).where(c("run_id").isNotNull())
    first = F.array(step("coverage", c("coverage")), F.when(c("earned").isNotNull(), step("score", c("earned"))), F.when(gate, step("coverage_gate", outcome=c("band"))))
    blockers = F.when(blocked, F.transform(F.split("blockers", ","), lambda b: step("blocker", outcome=b))).otherwise(F.array())
    last = F.array(F.when(~gate & ~blocked, step("band", outcome=c("band"))), F.when(~gate & (c("why") != ""), step("human_required", outcome=c("why"))))
    steps = F.array_compact(F.concat(first, blockers, last))
    return rows.select("run_id", F.posexplode(steps).alias("nth", "s")).select("run_id", (c("nth") + 1).cast("bigint").alias("nth"), "s.rule", "s.value", "s.outcome")


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason to look at a run, in order, and the status that follows. A run without a recommendation has to be looked at by a person."""
    c = F.col
    asked = c("assessed") & (c("reasons") == "")
    rows = dealt(runs(spark, sf_dir).select("run_id")).join(judged(calls(spark, sf_dir)), "run_id", "left").join(flagged(spark, sf_dir), "run_id", "left")
    named = [F.when(~F.coalesce(asked, F.lit(False)), "requires_human"), *(F.when(c(f), f) for f in ("integrity", "partial_profile", "invalid_span", "budget_capped")), F.when(c("contradicted") & c("assessed"), "contradicted"), F.when(c("degraded"), "degraded")]
    flags = F.array_compact(F.array(*named))
    return rows.select("run_id", F.array_join(flags, ",").alias("flags"), F.when(F.size(flags) > 0, "needs_review").otherwise("ready_for_review").alias("status"))


#: Statuses and what may follow each.
EDGES = (
    ("created", ("intake_ok", "failed_terminal",)),
    ("intake_ok", ("extracted", "failed_terminal",)),
    ("extracted", ("sanitized", "failed_terminal",)),
    ("sanitized", ("structured", "quarantined",)),
    ("structured", ("calibrated",)),
    ("calibrated", ("assessed",)),
    ("assessed", ("aggregated", "manual_review_required",)),
    ("aggregated", ("composed",)),
    ("composed", ("ready_for_review", "needs_review",)),
    ("ready_for_review", ("approved", "rejected", "needs_info",)),
    ("needs_review", ("approved", "rejected", "needs_info",)),
    ("quarantined", ("needs_review", "rejected",)),
    ("manual_review_required", ("needs_review",)),
    ("needs_info", ("created",)),
    ("approved", ("delivered", "delivery_pending_retry",)),
    ("delivery_pending_retry", ("delivered",)),
    ("interrupted", ("created",)),
)
EDGE_ROWS = [(a, b) for a, targets in EDGES for b in targets]
KINDS = {"view": "created", "click": "intake_ok", "purchase": "extracted", "signup": "sanitized", "error": "failed_terminal"}


def edges(spark: SparkSession) -> DataFrame:
    return fixtures.frame(spark, "src string, dst string", EDGE_ROWS)


def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of runs, event to event, that the table of statuses does not have."""
    status = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("kind"))
    in_run = Window.partitionBy("run_id").orderBy("happened", "event_id")
    moves = run_events(spark, sf_dir).select(status.alias("dst"), F.lag(status).over(in_run).alias("src")).where(F.col("src").isNotNull() & (F.col("src") != F.col("dst")))
    return moves.join(F.broadcast(edges(spark)), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.count("*").alias("n"))


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses that each status can reach, and in how few steps; the graph is fixed and small, and the search ends when a round finds nothing new."""
    step = edges(spark)
    found = front = step.select("src", "dst", F.lit(1).alias("steps"))
    n = 1
    while front.limit(1).count():
        n += 1
        onward = front.alias("f").join(F.broadcast(step).alias("e"), F.col("f.dst") == F.col("e.src")).select("f.src", F.col("e.dst").alias("dst")).distinct()
        rows = onward.join(F.broadcast(found), ["src", "dst"], "left_anti").collect()
        front = fixtures.frame(spark, "src string, dst string, steps int", [(r["src"], r["dst"], n) for r in rows])
        found = found.unionAll(front)
    return found


def simple_paths(spark: SparkSession, sf_dir: str, start: str = "created") -> DataFrame:
    """Every simple path of statuses from ``start``, and how many moves of runs were made over its last step.

    A path is extended by statuses that it has not visited, so cycles end by themselves; each path is one to its last status. The
    table of statuses is fixed and small; the moves are those of all runs.
    """
    values = ", ".join(f"('{a}', '{b}')" for a, b in EDGE_ROWS)
    paths = spark.sql(f"""WITH RECURSIVE edge(src, dst) AS (VALUES {values}), p(node, path) AS (
        SELECT CAST('{start}' AS STRING), array(CAST('{start}' AS STRING)) UNION ALL SELECT dst, array_append(path, dst) FROM p JOIN edge ON node = src WHERE NOT array_contains(path, dst)) SELECT node, path FROM p WHERE size(path) > 1""")
    status = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("kind"))
    in_run = Window.partitionBy("run_id").orderBy("happened", "event_id")
    moves = run_events(spark, sf_dir).select(F.lag(status).over(in_run).alias("src"), status.alias("dst")).where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count("*").alias("n_moves"))
    steps = paths.select(F.array_join("path", ">").alias("path"), F.col("node").alias("status"), (F.size("path") - 1).cast("bigint").alias("n_steps"), F.element_at("path", -2).alias("src"), F.col("node").alias("dst"))
    return steps.join(F.broadcast(moves), ["src", "dst"], "left").select("path", "status", "n_steps", F.coalesce("n_moves", F.lit(0)).alias("n_moves"))


_COUNTS = f"""{CALLS}, n AS (SELECT run_id, call_no AS ord, sum((latency_ms % 4 <> 0)::INT) AS supported, sum((latency_ms % 7 = 0)::INT) AS contradicted, max(CASE WHEN input_tokens > 4900 THEN 'budget' END) AS unassessed
    FROM calls WHERE call_no <= 5 GROUP BY ALL), {fixtures.sql("k", CRITERIA_SCHEMA, CRITERIA)},
s AS (SELECT r.run_id, k.*, n.unassessed, coalesce(supported, 0) AS sp, coalesce(contradicted, 0) AS ct, CASE WHEN n.unassessed IS NOT NULL OR (sp = 0 AND ct = 0) THEN '{UNKNOWN}' WHEN sp > 0 AND ct > 0 THEN 'contradicted'
    WHEN sp = 0 THEN 'not_met' WHEN sp >= min_supported THEN 'met' ELSE 'partial' END AS state FROM (SELECT DISTINCT run_id FROM n) r CROSS JOIN k LEFT JOIN n ON n.run_id = r.run_id AND n.ord = k.ord)"""


def _recommend(states: str, name: str) -> str:
    bands = " ".join(f"WHEN earned >= {least} THEN '{band}'" for least, band in BANDS)
    return f"""{name}_a AS (SELECT run_id, sum(CASE WHEN state <> '{UNKNOWN}' THEN weight ELSE 0 END) / sum(weight) AS coverage,
    sum(CASE WHEN state <> '{UNKNOWN}' THEN weight * CASE state WHEN 'met' THEN met WHEN 'partial' THEN partial ELSE 0 END END) / sum(CASE WHEN state <> '{UNKNOWN}' THEN weight END) AS earned,
    min(CASE WHEN kind = 'blocker' AND state IN ('not_met', 'contradicted') THEN ord END) AS failed, min(CASE WHEN kind = 'blocker' AND state = '{UNKNOWN}' THEN ord END) AS asked,
    coalesce(string_agg(criterion, ',' ORDER BY ord) FILTER (kind = 'blocker' AND state IN ('not_met', 'contradicted', '{UNKNOWN}')), '') AS blockers,
    bool_or(state = 'contradicted') AS conflict, bool_or(unassessed IS NOT NULL) AS unassessed FROM {states} GROUP BY run_id),
{name}_g AS (SELECT *, earned IS NULL OR coverage < {MIN_COVERAGE} AS gate, CASE WHEN earned IS NULL OR coverage < {MIN_COVERAGE} THEN 'insufficient_information' WHEN failed IS NOT NULL THEN 'decline' WHEN asked IS NOT NULL THEN 'manual_review_required' {bands} END AS band FROM {name}_a),
{name} AS (SELECT run_id, band, round(CASE WHEN band NOT IN ('insufficient_information', 'manual_review_required') THEN earned END, 6) AS score, round(coverage, 6) AS coverage, round(earned, 6) AS earned, CASE WHEN gate THEN '' ELSE blockers END AS blockers,
    CASE WHEN gate THEN 'low_coverage' ELSE concat_ws(',', CASE WHEN asked IS NOT NULL AND (failed IS NULL OR asked < failed) THEN 'blocker_unknown' END, CASE WHEN conflict THEN 'contradicted_evidence' END, CASE WHEN unassessed THEN 'unassessed_criterion' END) END AS reasons FROM {name}_g)"""


_OVERLAYS = f"""t AS ({integrity.QUERIES['integrity_tiers'][1]}),
m AS (SELECT run_id, count(*) AS c, bool_or(latency_ms % 11 = 0) AS bad, bool_or(call_no <= 5 AND input_tokens > 4900) AS capped, bool_or(retried AND changed) AS degraded FROM calls GROUP BY run_id)"""
_HUMAN = f"""{RUNS}, {_COUNTS}, {_recommend('s', 'r')}, {_OVERLAYS},
h AS (SELECT r.run_id, CASE WHEN reasons = 'low_coverage' THEN reasons ELSE concat_ws(',', CASE WHEN contains(reasons, 'blocker_unknown') THEN 'blocker_unknown' END, CASE WHEN contains(reasons, 'contradicted_evidence') THEN 'contradicted_evidence' END,
    CASE WHEN runs.run_id IS NOT NULL AND tier <> 'clean' THEN 'integrity' END, CASE WHEN runs.run_id IS NOT NULL AND bad THEN 'invalid_span' END, CASE WHEN runs.run_id IS NOT NULL AND c = 1 THEN 'partial_profile' END,
    CASE WHEN runs.run_id IS NOT NULL AND capped THEN 'budget_capped' END, CASE WHEN contains(reasons, 'unassessed_criterion') THEN 'unassessed_criterion' END) END AS reasons
    FROM r LEFT JOIN runs USING (run_id) LEFT JOIN m USING (run_id) LEFT JOIN t ON t.id = r.run_id)"""
_EDGES = fixtures.sql("edge", "src string, dst string", EDGE_ROWS)

_STATUS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in KINDS.items()) + " END"

QUERIES = {
    "recommendations": (recommendations, f"WITH {_COUNTS}, {_recommend('s', 'r')} SELECT * FROM r"),
    "recomputed": (recomputed, f"""WITH {_COUNTS}, o AS (SELECT * REPLACE (CASE WHEN run_id % 7 = 0 AND ord = 2 THEN CASE state WHEN 'met' THEN 'not_met' ELSE 'met' END ELSE state END AS state,
        CASE WHEN run_id % 7 = 0 AND ord = 2 THEN NULL ELSE unassessed END AS unassessed) FROM s), {_recommend('s', 'r')}, {_recommend('o', 'p')}
        SELECT r.band AS old_band, p.band, count(*) AS n FROM p JOIN r USING (run_id) GROUP BY ALL"""),
    "review_flags": (review_flags, f"""WITH {RUNS}, {_COUNTS}, {_recommend('s', 'r')}, q AS (SELECT run_id, bool_or(state = 'contradicted') AS conflict FROM s GROUP BY run_id), {_OVERLAYS},
        f AS (SELECT u.run_id, concat_ws(',', CASE WHEN reasons IS NULL OR reasons <> '' THEN 'requires_human' END, CASE WHEN tier <> 'clean' THEN 'integrity' END, CASE WHEN c = 1 THEN 'partial_profile' END, CASE WHEN bad THEN 'invalid_span' END,
            CASE WHEN capped THEN 'budget_capped' END, CASE WHEN q.conflict THEN 'contradicted' END, CASE WHEN degraded THEN 'degraded' END) AS flags
            FROM runs u LEFT JOIN r USING (run_id) LEFT JOIN q USING (run_id) LEFT JOIN m USING (run_id) LEFT JOIN t ON t.id = u.run_id)
        SELECT run_id, flags, CASE WHEN flags <> '' THEN 'needs_review' ELSE 'ready_for_review' END AS status FROM f"""),
    "human_reasons": (human_reasons, f"WITH {_HUMAN} SELECT * FROM h"),
    "derivations": (derivations, f"""WITH {_HUMAN}, a AS (SELECT r.*, h.reasons AS why, band = 'insufficient_information' AS gate FROM r JOIN h USING (run_id)),
        l AS (SELECT run_id, list_filter(list_concat([{{'rule': 'coverage', 'value': coverage::DOUBLE, 'outcome': NULL::VARCHAR}}, CASE WHEN earned IS NOT NULL THEN {{'rule': 'score', 'value': earned::DOUBLE, 'outcome': NULL::VARCHAR}} END,
                CASE WHEN gate THEN {{'rule': 'coverage_gate', 'value': NULL::DOUBLE, 'outcome': band}} END],
            list_transform(list_filter(string_split(blockers, ','), lambda b: b <> ''), lambda b: {{'rule': 'blocker', 'value': NULL::DOUBLE, 'outcome': b}}),
            [CASE WHEN NOT gate AND blockers = '' THEN {{'rule': 'band', 'value': NULL::DOUBLE, 'outcome': band}} END, CASE WHEN NOT gate AND why <> '' THEN {{'rule': 'human_required', 'value': NULL::DOUBLE, 'outcome': why}} END]), lambda x: x IS NOT NULL) AS steps FROM a)
        SELECT run_id, k::BIGINT AS nth, steps[k].rule AS rule, steps[k].value AS value, steps[k].outcome AS outcome FROM l, range(1, len(steps) + 1) AS n(k)"""),
    "illegal_transitions": (illegal_transitions, f"""WITH {_EDGES}, {EVENTS}, m AS (SELECT {{}} AS dst, run_id, happened, event_id FROM run_events), l AS (SELECT dst, lag(dst) OVER (PARTITION BY run_id ORDER BY happened, event_id) AS src FROM m)
        SELECT src, dst, count(*) AS n FROM l ANTI JOIN edge USING (src, dst) WHERE src IS NOT NULL AND src <> dst GROUP BY ALL""".replace("{}", _STATUS)),
    "reachable": (reachable, f"""WITH RECURSIVE {_EDGES}, p(src, dst) AS (SELECT src, dst FROM edge UNION SELECT p.src, e.dst FROM p JOIN edge e ON p.dst = e.src),
        w(src, dst, steps) AS (SELECT src, dst, 1 FROM edge UNION SELECT w.src, e.dst, steps + 1 FROM w JOIN edge e ON w.dst = e.src WHERE steps < (SELECT count(DISTINCT src) + 1 FROM edge)) SELECT src, dst, min(steps) AS steps FROM p JOIN w USING (src, dst) GROUP BY ALL"""),
    "simple_paths": (simple_paths, f"""WITH RECURSIVE {_EDGES}, {EVENTS}, p(node, path) AS (SELECT 'created'::VARCHAR, ['created'::VARCHAR] UNION ALL SELECT dst, list_append(path, dst) FROM p JOIN edge ON node = src WHERE NOT list_contains(path, dst)),
        m AS (SELECT {_STATUS} AS dst, lag({_STATUS}) OVER (PARTITION BY run_id ORDER BY happened, event_id) AS src FROM run_events), n AS (SELECT src, dst, count(*) AS n_moves FROM m WHERE src <> dst GROUP BY ALL)
        SELECT array_to_string(path, '>') AS path, node AS status, len(path) - 1 AS n_steps, coalesce(n_moves, 0) AS n_moves FROM p LEFT JOIN n ON n.dst = node AND n.src = path[len(path) - 1] WHERE len(path) > 1"""),
}
