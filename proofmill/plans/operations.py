"""Operational metrics and the control of runs, over the views of the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.functions.stats import money, share
from proofmill.plans.views import AS_OF_EVENTS, AS_OF_RUNS, CALLS, EVENTS, PRICES_SQL, RUNS, calls, prices, run_events, runs

IDLE = ("delivered", "needs_review")
#: Days that metrics of runs look back.
WINDOW_DAYS = 365


def _moment(at: str) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


# -- counts and lists


def runs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: runs of the last 365 days by status."""
    recent = runs(spark, sf_dir).where(F.col("started_at") >= _moment(AS_OF_RUNS) - _days(365))
    return recent.groupBy("status").agg(F.count("*").alias("n_runs"))


def stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: unfinished runs, not waiting for a person, older than a year; oldest first is left to the reader."""
    old = (F.col("finished_at").isNull()) & ~F.col("status").isin(*IDLE) & (F.col("started_at") < _moment(AS_OF_RUNS) - _days(365))
    return runs(spark, sf_dir).where(old).select("run_id", "status", "started_at")


def list_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest runs of some statuses; ties by run."""
    wanted = runs(spark, sf_dir).where(F.col("status").isin("structured", "assessed"))
    return wanted.orderBy(F.desc("started_at"), "run_id").limit(50).select("run_id", "status", "started_at")


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a window by kind and day, nulls left out."""
    recent = run_events(spark, sf_dir).where((F.col("happened") >= _moment(AS_OF_EVENTS) - _days(7)) & F.col("kind").isNotNull())
    return recent.groupBy("kind", F.date_format("happened", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n_events"))


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, calls and escalations of every run; 0 for a run without calls."""
    used = calls(spark, sf_dir).groupBy("run_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("t"), F.count("*").alias("c"), F.count_if("escalated").alias("e"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return runs(spark, sf_dir).select("run_id").join(used, "run_id", "left").select("run_id", zero("t", "tokens"), zero("c", "n_calls"), zero("e", "n_escalated"))


def priced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = money(F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), F.col("p_in"), F.col("p_out"), F.col("p_cached"))
    return calls(spark, sf_dir).join(F.broadcast(prices(spark)), "tier", "left").withColumn("cost", cost)


def cost_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each call; null where its tier has no price."""
    return priced_calls(spark, sf_dir).select("run_id", "call_no", "tier", F.col("cost").cast("double").alias("cost"))


def cost_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all runs by policy their number, calls, tokens and cost, and the cost of one and of a hundred.

    A run costs what its priced calls do, and nothing is known of one without any; the mean is the known total over all runs.
    """
    per_run = priced_calls(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("c"), F.sum("input_tokens").alias("t"), F.sum("output_tokens").alias("o"), F.sum("cost").alias("cost"))
    total = F.sum("cost").cast("double")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return runs(spark, sf_dir).join(per_run, "run_id", "left").groupBy("policy").agg(
        F.count("*").alias("n_runs"), zero("c").alias("n_calls"), zero("t").alias("input_tokens"), zero("o").alias("output_tokens"),
        total.alias("total_cost"), F.round(total / F.count("*"), 6).alias("mean_cost"), F.round(total / F.count("*") * 100, 4).alias("per_hundred"),
    )


def escalation_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalated calls by site, how many changed the outcome, and the rates."""
    by_site = calls(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n"), F.count_if("escalated").alias("n_escalated"), F.count_if(F.col("escalated") & F.col("changed")).alias("n_changed"))
    return by_site.select("site", "n", "n_escalated", "n_changed", share(F.col("n_escalated"), F.col("n")).alias("escalation_rate"), share(F.col("n_changed"), F.col("n_escalated")).alias("changed_rate"))


def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the last 365 days and, per call of theirs, failed validations, invalid spans, retries and repairs; the rates are null without calls."""
    recent = runs(spark, sf_dir).where(F.col("started_at") >= _moment(AS_OF_RUNS) - _days(365)).select("run_id")
    kinds = {"validation_failure": F.col("latency_ms") > 900, "invalid_span": F.col("latency_ms") % 11 == 0, "retry": F.col("retried"), "repair": F.col("retried") & F.col("changed")}
    per_run = calls(spark, sf_dir).join(recent, "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n"), *(F.count_if(when).alias(kind) for kind, when in kinds.items()))
    totals = recent.join(per_run, "run_id", "left").agg(F.count("*").alias("n_runs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *kinds)))
    return totals.select("n_runs", "n", *(F.round(share(F.col(kind), F.col("n")), 6).alias(f"{kind}_rate") for kind in kinds))


def override_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overridden share of decided runs by policy."""
    decided = runs(spark, sf_dir).where(F.col("status") == "delivered").groupBy("policy").agg(F.count("*").alias("n"), F.count_if(F.col("override_count") > 0).alias("k"))
    return decided.select("policy", "n", "k", share(F.col("k"), F.col("n")).alias("rate"))


def run_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank seconds and the mean of finished runs by policy and month, from counts of each duration, so no group is collected."""
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000
    done = runs(spark, sf_dir).where(F.col("finished_at").isNotNull()).select("policy", F.date_format("started_at", "yyyy-MM").alias("month"), seconds.alias("s"))
    group = Window.partitionBy("policy", "month")
    ranked = done.groupBy("policy", "month", "s").agg(F.count("*").alias("c")).withColumns({"upto": F.sum("c").over(group.orderBy("s")), "all": F.sum("c").over(group)})
    at = lambda f: F.min(F.when(F.col("upto") > F.bround(F.lit(f) * (F.col("all") - 1), 0), F.col("s")))
    return ranked.groupBy("policy", "month").agg(F.max("all").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(F.sum(F.col("c") * F.col("s")) / F.max("all"), 6).alias("mean"))


def call_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank latency by site, from counts of each latency, so no group is collected."""
    counts = calls(spark, sf_dir).where(F.col("latency_ms").isNotNull()).groupBy("site", "latency_ms").agg(F.count("*").alias("c"))
    by_site = Window.partitionBy("site")
    ranked = counts.withColumns({"upto": F.sum("c").over(by_site.orderBy("latency_ms")), "n": F.sum("c").over(by_site)})
    at = lambda f: F.min(F.when(F.col("upto") > F.least(F.bround(F.lit(f) * (F.col("n") - 1), 0), F.col("n") - 1), F.col("latency_ms")))
    return ranked.groupBy("site").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.sum(F.col("c") * F.col("latency_ms")).alias("total_ms"))


# -- latest, sequence, supersession


def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose last event, or start without any, is older than two days; one join, no loop over runs."""
    last = run_events(spark, sf_dir).groupBy("run_id").agg(F.max_by("happened", F.struct("happened", "event_id")).alias("last_at"))
    known = runs(spark, sf_dir).where(~F.col("status").isin("delivered")).join(last, "run_id", "left")
    seen = F.coalesce("last_at", "started_at")
    return known.where(seen < _moment(AS_OF_EVENTS) - _days(2)).select("run_id", seen.alias("last_seen"))


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each run and kind, by time then id."""
    newest = run_events(spark, sf_dir).groupBy("run_id", "kind").agg(F.max(F.struct("happened", "event_id", "value")).alias("e"))
    return newest.select("run_id", "kind", "e.event_id", "e.happened", "e.value")


def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a run numbered by time, then id."""
    in_run = Window.partitionBy("run_id").orderBy("happened", "event_id")
    return run_events(spark, sf_dir).select("run_id", "event_id", F.row_number().over(in_run).cast("bigint").alias("seq"))


def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an append-only log, when each row was replaced by the next of its key; null for the current one."""
    by_key = Window.partitionBy("run_id", "kind").orderBy("happened", "event_id")
    return run_events(spark, sf_dir).select("event_id", F.lead("happened").over(by_key).alias("superseded_at"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of runs with one content key the first claims it and the others are duplicates of it."""
    keyed = runs(spark, sf_dir).withColumn("content_key", F.sha2(F.concat_ws("|", "candidate", "policy"), 256))
    first = F.min_by("run_id", F.struct("started_at", "run_id")).over(Window.partitionBy("content_key"))
    return keyed.select("run_id", "content_key", first.alias("claimed_by"), (F.col("run_id") == first).alias("claims"))


def guarded_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that expect a version: accepted where it is the current one, else stale or unknown."""
    current = run_events(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("version"))
    asked = runs(spark, sf_dir).select("run_id", (F.col("candidate") % 100).alias("expects"))
    outcome = F.when(F.col("version").isNull(), "unknown").when(F.col("version") == F.col("expects"), "accepted").otherwise("stale")
    return asked.join(current, "run_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def overrides_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overridden runs joined to the candidate's segment."""
    from proofmill.tables import read_table

    people = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate"), F.col("c_mktsegment").alias("segment"))
    hit = runs(spark, sf_dir).where(F.col("override_count") > 0).join(people, "candidate")
    return hit.groupBy("segment").agg(F.count("*").alias("n_runs"), F.sum("override_count").alias("n_overrides"))


def calls_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected call numbers of each run and site, in order."""
    by = calls(spark, sf_dir).groupBy("run_id", "site")
    listed = lambda want: F.array_join(F.array_sort(F.collect_list(F.when(F.col("escalated") == want, F.col("call_no")))).cast("array<string>"), ",")
    return by.agg(listed(False).alias("accepted"), listed(True).alias("rejected"))


def escalation_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the attempts at each run and site the one that counts: the last escalated one, else the first.

    The state before the escalation stays known, and what any attempt had rejected is kept, in the order of the attempts. A call's
    latency stands for its state and for what it rejected.
    """
    c = F.col
    state = F.element_at(F.array(*map(F.lit, ("met", "partial", "not_met"))), (c("latency_ms") % 3 + 1).cast("int"))
    place = F.struct("call_no", "latency_ms", "input_tokens", "cached_tokens")
    tried = calls(spark, sf_dir).select("run_id", "site", "escalated", state.alias("state"), "call_no", place.alias("place"), F.when(c("latency_ms") % 11 == 0, F.concat_ws(":", "call_no", "latency_ms")).alias("bad"))
    strong = F.max_by(F.struct("call_no", "state"), F.when(c("escalated"), c("place")))
    first = F.min_by(F.struct("call_no", "state"), c("place"))
    kept = F.transform(F.array_sort(F.collect_list(F.when(c("bad").isNotNull(), F.struct("place", "bad")))), lambda x: x["bad"])
    by = tried.groupBy("run_id", "site").agg(first.alias("f"), strong.alias("s"), F.bool_or("escalated").alias("escalated"), F.array_join(kept, ",").alias("rejected"))
    pick = F.when(c("escalated"), c("s")).otherwise(c("f"))
    return by.select("run_id", "site", pick["call_no"].alias("call_no"), pick["state"].alias("state"), "escalated", F.when(c("escalated"), c("f.state")).alias("state_before"), "rejected")


# -- deletion and retention


def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retention of five years deletes: finished runs, their calls, and candidates that no kept run refers to."""
    all_runs = runs(spark, sf_dir)
    gone = all_runs.where(F.col("finished_at") < _moment(AS_OF_RUNS) - _days(5 * 365))
    lost_calls = calls(spark, sf_dir).join(gone.select("run_id"), "run_id", "left_semi")
    kept = all_runs.join(gone.select("run_id"), "run_id", "left_anti")
    lost_people = gone.select("candidate").distinct().join(kept.select("candidate"), "candidate", "left_anti")
    part = lambda name, frame: frame.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return part("runs", gone).unionAll(part("calls", lost_calls)).unionAll(part("candidates", lost_people))


def deliveries_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks that a delivered run has not reached yet; appending only these makes a sink idempotent."""
    sinks = spark.createDataFrame([("csv",), ("sheet",)], "sink string")
    due = runs(spark, sf_dir).where(F.col("status") == "delivered").select("run_id").crossJoin(F.broadcast(sinks))
    sent = calls(spark, sf_dir).where(F.col("call_no").isin(1, 2)).select("run_id", F.when(F.col("call_no") == 1, "csv").otherwise("sheet").alias("sink")).where(F.col("run_id") % 2 == 0)
    return due.join(sent, ["run_id", "sink"], "left_anti").groupBy("sink").agg(F.count("*").alias("n_outstanding"))


# -- control


#: Thresholds of the routed policy; no floor of money is set.
MOST_ESCALATIONS, LEAST_HEADROOM, LEAST_CONFIDENCE, TOKEN_CEILING = 3, 0.15, 0.6, 30_000
START_STRONG = ("high_stakes", "blocker")


#: Triggers that send a call to the strong tier.
ESCALATING = ("high_stakes", "invalid_span", "low_confidence", "repair_failed")


def triggered(frame: DataFrame) -> DataFrame:
    """Calls with ``again`` (it is another attempt) and ``trigger``: the first rule of the routed policy that applies, before the call is made."""
    c = F.col
    before = Window.partitionBy("run_id").orderBy("call_no", "latency_ms", "input_tokens", "cached_tokens", "escalated").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(c("input_tokens") + c("output_tokens")).over(before), F.lit(0))
    used = F.coalesce(F.sum(c("escalated").cast("bigint")).over(before), F.lit(0))
    kind = F.element_at(F.array(*map(F.lit, ("standard", "high_stakes", "blocker", "standard", "standard", "standard", "standard"))), c("call_no").cast("int"))
    confidence = F.when(c("cached_tokens") > 0, c("latency_ms") % 100 / 100)
    again = c("again")
    first = (
        F.when(again & (1 - c("_spent") / TOKEN_CEILING < LEAST_HEADROOM), "budget_blocked")
        .when(again & (c("_used") >= MOST_ESCALATIONS), "capped")
        .when(~again & kind.isin(*START_STRONG), "high_stakes")
        .when(again & (c("latency_ms") % 11 == 0), "invalid_span")
        .when(again & (confidence < LEAST_CONFIDENCE), "low_confidence")
        .when(again & c("retried"), "repair_failed")
        .otherwise("initial")
    )
    return frame.withColumns({"again": c("latency_ms") % 3 > 0, "_spent": spent, "_used": used}).withColumn("trigger", first).drop("_spent", "_used")


def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under each policy how many calls go to which tier, by the first trigger that applies."""
    strong, again = F.col("trigger").isin(*ESCALATING), F.col("again")
    pick = lambda policy, tier, trigger: F.struct(F.lit(policy).alias("policy"), tier.alias("tier"), trigger.alias("trigger"))
    picks = F.array(
        pick("all_cheap", F.lit("cheap"), F.when(again, "capped").otherwise("initial")),
        pick("all_strong", F.lit("strong"), F.lit("initial")),
        pick("routed", F.when(strong, "strong").otherwise("cheap"), F.col("trigger")),
    )
    return triggered(calls(spark, sf_dir)).select(F.explode(picks).alias("p")).groupBy("p.policy", "p.tier", "p.trigger").agg(F.count("*").alias("n"))


def escalation_by_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the calls that a trigger sent to the strong tier, how many each one sent and how many of those changed the outcome."""
    sent = triggered(calls(spark, sf_dir)).where(F.col("trigger").isin(*ESCALATING))
    counted = sent.groupBy("trigger").agg(F.count("*").alias("n_escalated"), F.count_if("changed").alias("n_changed"))
    return counted.select("trigger", "n_escalated", "n_changed", share(F.col("n_changed"), F.col("n_escalated")).alias("changed_rate"))


def budget_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: the call at which a run's tokens reach 15000, or at which it escalates the third time."""
    in_run = Window.partitionBy("run_id").orderBy("call_no", "latency_ms", "input_tokens", "cached_tokens", "escalated").rowsBetween(Window.unboundedPreceding, 0)
    running = calls(spark, sf_dir).withColumns({"tokens": F.sum(F.col("input_tokens") + F.col("output_tokens")).over(in_run), "escalations": F.sum(F.col("escalated").cast("bigint")).over(in_run)})
    over = running.where((F.col("tokens") >= 15000) | (F.col("escalations") >= 3))
    return over.groupBy("run_id").agg(F.min(F.struct("call_no", "tokens", "escalations")).alias("b")).select("run_id", "b.call_no", "b.tokens", "b.escalations")


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts over all runs."""
    s = lambda *names: F.count_if(F.col("status").isin(*names))
    return runs(spark, sf_dir).agg(F.count("*").alias("n"), s("needs_review").alias("reviewable"), s("delivered").alias("delivered"), s("structured", "assessed").alias("in_flight"), F.count_if(F.col("finished_at").isNull()).alias("open"))


_R = "WITH " + RUNS
_C = "WITH " + CALLS
_E = "WITH " + EVENTS
#: Exact in integers: prices have six places, so a cost is a number of 10^-12 that is rounded half up to 10^-6.
_UNITS = """floor(((greatest(input_tokens - cached_tokens, 0)::HUGEINT * (p_in * 1000000)::HUGEINT + output_tokens::HUGEINT * (p_out * 1000000)::HUGEINT + cached_tokens::HUGEINT * (p_cached * 1000000)::HUGEINT) + 500000) // 1000000)"""

_TRIGGERS = f"""{_C}, a AS (SELECT call_no, latency_ms % 3 > 0 AS again, coalesce(sum(escalated::INT) OVER w, 0) AS used, 1 - coalesce(sum(input_tokens + output_tokens) OVER w, 0) / {TOKEN_CEILING} AS room,
        latency_ms % 11 = 0 AS bad, CASE WHEN cached_tokens > 0 THEN (latency_ms % 100) / 100 END AS sure, retried, changed FROM calls WINDOW w AS (PARTITION BY run_id ORDER BY call_no, latency_ms, input_tokens, cached_tokens, escalated ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT again, changed, CASE WHEN again AND room < {LEAST_HEADROOM} THEN 'budget_blocked' WHEN again AND used >= {MOST_ESCALATIONS} THEN 'capped' WHEN NOT again AND call_no IN (2, 3) THEN 'high_stakes' WHEN again AND bad THEN 'invalid_span'
        WHEN again AND sure < {LEAST_CONFIDENCE} THEN 'low_confidence' WHEN again AND retried THEN 'repair_failed' ELSE 'initial' END AS trigger FROM a)"""

def cost_sql(where: str = "") -> str:
    """Cost by policy of all runs, or of those that a condition leaves."""
    return f"""WITH {RUNS}, {CALLS}, {PRICES_SQL}, p AS (SELECT *, {_UNITS} AS cost FROM calls LEFT JOIN prices USING (tier)),
        r AS (SELECT run_id, count(*) AS c, sum(input_tokens) AS t, sum(output_tokens) AS o, sum(cost) AS cost FROM p GROUP BY run_id)
        SELECT policy, count(*) AS n_runs, coalesce(sum(c), 0)::BIGINT AS n_calls, coalesce(sum(t), 0)::BIGINT AS input_tokens, coalesce(sum(o), 0)::BIGINT AS output_tokens, sum(cost)::DOUBLE / 1000000 AS total_cost,
            round(sum(cost)::DOUBLE / 1000000 / count(*), 6) AS mean_cost, round(sum(cost)::DOUBLE / 1000000 / count(*) * 100, 4) AS per_hundred
        FROM runs LEFT JOIN r USING (run_id){where} GROUP BY policy"""


QUERIES = {
    "runs_by_status": (runs_by_status, f"{_R} SELECT status, count(*) AS n_runs FROM runs WHERE started_at >= TIMESTAMP '{AS_OF_RUNS}' - INTERVAL 365 DAY GROUP BY 1"),
    "stuck_runs": (stuck_runs, f"{_R} SELECT run_id, status, started_at FROM runs WHERE finished_at IS NULL AND status NOT IN {IDLE} AND started_at < TIMESTAMP '{AS_OF_RUNS}' - INTERVAL 365 DAY"),
    "list_by_status": (list_by_status, f"{_R} SELECT run_id, status, started_at FROM runs WHERE status IN ('structured', 'assessed') ORDER BY started_at DESC, run_id LIMIT 50"),
    "error_codes": (error_codes, f"{_E} SELECT kind, strftime(happened, '%Y-%m-%d') AS day, count(*) AS n_events FROM run_events WHERE happened >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY AND kind IS NOT NULL GROUP BY ALL"),
    "token_totals": (token_totals, f"""WITH {RUNS}, {CALLS} SELECT run_id, coalesce(sum(input_tokens + output_tokens), 0)::BIGINT AS tokens, count(call_no) AS n_calls,
        coalesce(sum(escalated::INT), 0)::BIGINT AS n_escalated FROM runs LEFT JOIN calls USING (run_id) GROUP BY run_id"""),
    "cost_of_calls": (cost_of_calls, f"WITH {CALLS}, {PRICES_SQL} SELECT run_id, call_no, tier, ({_UNITS})::DOUBLE / 1000000 AS cost FROM calls LEFT JOIN prices USING (tier)"),
    "cost_by_policy": (cost_by_policy, cost_sql()),
    "escalation_by_site": (escalation_by_site, f"""{_C} SELECT site, count(*) AS n, sum(escalated::INT)::BIGINT AS n_escalated, sum((escalated AND changed)::INT)::BIGINT AS n_changed,
        sum(escalated::INT) / count(*) AS escalation_rate, sum((escalated AND changed)::INT) / nullif(sum(escalated::INT), 0) AS changed_rate FROM calls GROUP BY site"""),
    "failure_rates": (failure_rates, f"""WITH {RUNS}, {CALLS}, r AS (SELECT run_id FROM runs WHERE started_at >= TIMESTAMP '{AS_OF_RUNS}' - INTERVAL 365 DAY), c AS (SELECT * FROM calls SEMI JOIN r USING (run_id))
        SELECT (SELECT count(*) FROM r) AS n_runs, count(*) AS n, round(count(*) FILTER (latency_ms > 900) / nullif(count(*), 0), 6) AS validation_failure_rate, round(count(*) FILTER (latency_ms % 11 = 0) / nullif(count(*), 0), 6) AS invalid_span_rate,
            round(count(*) FILTER (retried) / nullif(count(*), 0), 6) AS retry_rate, round(count(*) FILTER (retried AND changed) / nullif(count(*), 0), 6) AS repair_rate FROM c"""),
    "override_rate": (override_rate, f"{_R} SELECT policy, count(*) AS n, sum((override_count > 0)::INT)::BIGINT AS k, sum((override_count > 0)::INT) / count(*) AS rate FROM runs WHERE status = 'delivered' GROUP BY policy"),
    "run_latency": (run_latency, f"""{_R}, s AS (SELECT policy, strftime(started_at, '%Y-%m') AS month, list_sort(list(epoch_us(finished_at - started_at) / 1000000.0)) AS v FROM runs WHERE finished_at IS NOT NULL GROUP BY ALL)
        SELECT policy, month, len(v)::BIGINT AS n, v[round_even(0.5 * (len(v) - 1), 0)::INT + 1] AS p50, v[round_even(0.95 * (len(v) - 1), 0)::INT + 1] AS p95, round(list_sum(v) / len(v), 6) AS mean FROM s"""),
    "call_latency": (call_latency, f"""{_C}, s AS (SELECT site, list_sort(list(latency_ms)) AS v FROM calls WHERE latency_ms IS NOT NULL GROUP BY site)
        SELECT site, len(v)::BIGINT AS n, v[round_even(0.5 * (len(v) - 1), 0)::INT + 1] AS p50, v[round_even(0.95 * (len(v) - 1), 0)::INT + 1] AS p95, list_sum(v)::BIGINT AS total_ms FROM s"""),
    "stale_runs": (stale_runs, f"""WITH {RUNS}, {EVENTS}, l AS (SELECT run_id, max(happened) AS last_at FROM run_events GROUP BY run_id)
        SELECT run_id, coalesce(last_at, started_at) AS last_seen FROM runs LEFT JOIN l USING (run_id) WHERE status <> 'delivered' AND coalesce(last_at, started_at) < TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 2 DAY"""),
    "latest_event": (latest_event, f"{_E} SELECT run_id, kind, event_id, happened, value FROM run_events QUALIFY row_number() OVER (PARTITION BY run_id, kind ORDER BY happened DESC, event_id DESC) = 1"),
    "event_sequence": (event_sequence, f"{_E} SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY happened, event_id) AS seq FROM run_events"),
    "supersession": (supersession, f"{_E} SELECT event_id, lead(happened) OVER (PARTITION BY run_id, kind ORDER BY happened, event_id) AS superseded_at FROM run_events"),
    "claims": (claims, f"""{_R}, k AS (SELECT run_id, started_at, sha256(concat_ws('|', candidate, policy)) AS content_key FROM runs)
        SELECT run_id, content_key, first_value(run_id) OVER w AS claimed_by, run_id = first_value(run_id) OVER w AS claims FROM k WINDOW w AS (PARTITION BY content_key ORDER BY started_at, run_id)"""),
    "guarded_updates": (guarded_updates, f"""WITH {RUNS}, {EVENTS}, v AS (SELECT run_id, count(*) AS version FROM run_events GROUP BY run_id)
        SELECT CASE WHEN version IS NULL THEN 'unknown' WHEN version = candidate % 100 THEN 'accepted' ELSE 'stale' END AS outcome, count(*) AS n FROM runs LEFT JOIN v USING (run_id) GROUP BY 1"""),
    "overrides_by_segment": (overrides_by_segment, f"{_R} SELECT c_mktsegment AS segment, count(*) AS n_runs, sum(override_count)::BIGINT AS n_overrides FROM runs JOIN customer ON candidate = c_custkey WHERE override_count > 0 GROUP BY 1"),
    "calls_reassembled": (calls_reassembled, f"""{_C} SELECT run_id, site, coalesce(string_agg(call_no, ',' ORDER BY call_no) FILTER (NOT escalated), '') AS accepted,
        coalesce(string_agg(call_no, ',' ORDER BY call_no) FILTER (escalated), '') AS rejected FROM calls GROUP BY ALL"""),
    "escalation_picks": (escalation_picks, f"""{_C}, a AS (SELECT run_id, site, escalated, call_no, ['met', 'partial', 'not_met'][latency_ms % 3 + 1] AS state, row_number() OVER (PARTITION BY run_id, site ORDER BY call_no, latency_ms, input_tokens, cached_tokens) AS nth,
            CASE WHEN latency_ms % 11 = 0 THEN call_no || ':' || latency_ms END AS bad FROM calls)
        SELECT run_id, site, coalesce(arg_max(call_no, nth) FILTER (escalated), arg_min(call_no, nth)) AS call_no, coalesce(arg_max(state, nth) FILTER (escalated), arg_min(state, nth)) AS state, bool_or(escalated) AS escalated,
            CASE WHEN bool_or(escalated) THEN arg_min(state, nth) END AS state_before, coalesce(string_agg(bad, ',' ORDER BY nth), '') AS rejected FROM a GROUP BY ALL"""),
    "purge": (purge, f"""WITH {RUNS}, {CALLS}, g AS (SELECT * FROM runs WHERE finished_at < TIMESTAMP '{AS_OF_RUNS}' - INTERVAL 1825 DAY), k AS (SELECT * FROM runs ANTI JOIN g USING (run_id))
        SELECT 'runs' AS what, count(*) AS n FROM g UNION ALL SELECT 'calls', count(*) FROM calls SEMI JOIN g USING (run_id)
        UNION ALL SELECT 'candidates', count(*) FROM (SELECT DISTINCT candidate FROM g ANTI JOIN k USING (candidate))"""),
    "deliveries_outstanding": (deliveries_outstanding, f"""WITH {RUNS}, {CALLS}, d AS (SELECT run_id, sink FROM runs, (VALUES ('csv'), ('sheet')) AS s(sink) WHERE status = 'delivered'),
        t AS (SELECT run_id, CASE call_no WHEN 1 THEN 'csv' ELSE 'sheet' END AS sink FROM calls WHERE call_no IN (1, 2) AND run_id % 2 = 0)
        SELECT sink, count(*) AS n_outstanding FROM d ANTI JOIN t USING (run_id, sink) GROUP BY sink"""),
    "routing": (routing, f"""{_TRIGGERS} SELECT 'routed' AS policy, CASE WHEN trigger IN {ESCALATING} THEN 'strong' ELSE 'cheap' END AS tier, trigger, count(*) AS n FROM t GROUP BY ALL
        UNION ALL SELECT 'all_cheap', 'cheap', CASE WHEN again THEN 'capped' ELSE 'initial' END, count(*) FROM t GROUP BY ALL UNION ALL SELECT 'all_strong', 'strong', 'initial', count(*) FROM t"""),
    "escalation_by_trigger": (escalation_by_trigger, f"{_TRIGGERS} SELECT trigger, count(*) AS n_escalated, count(*) FILTER (changed) AS n_changed, count(*) FILTER (changed) / count(*) AS changed_rate FROM t WHERE trigger IN {ESCALATING} GROUP BY trigger"),
    "budget_breaches": (budget_breaches, f"""{_C}, r AS (SELECT run_id, call_no, sum(input_tokens + output_tokens) OVER w AS tokens, sum(escalated::INT) OVER w AS escalations FROM calls WINDOW w AS (PARTITION BY run_id ORDER BY call_no, latency_ms, input_tokens, cached_tokens, escalated ROWS UNBOUNDED PRECEDING))
        SELECT run_id, call_no, tokens::BIGINT AS tokens, escalations::BIGINT AS escalations FROM r WHERE tokens >= 15000 OR escalations >= 3 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY call_no, tokens, escalations) = 1"""),
    "batch_summary": (batch_summary, f"""{_R} SELECT count(*) AS n, count(*) FILTER (status = 'needs_review') AS reviewable, count(*) FILTER (status = 'delivered') AS delivered,
        count(*) FILTER (status IN ('structured', 'assessed')) AS in_flight, count(*) FILTER (finished_at IS NULL) AS open FROM runs"""),
}
