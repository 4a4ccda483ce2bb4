"""All operational metrics in one pass: each row of the ledger says what it counts for, and one grouping adds it up.

Calls are grouped once, by grouping sets of run, site, latency and trigger; runs are joined to their totals once. A row then becomes the
measures that it counts for (metric, key, value to rank, n, k, cost), which are grouped by metric, key and value. So runs, calls,
events and texts are each scanned once, and percentiles come from counts of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.functions.stats import share
from proofmill.operators import integrity
from proofmill.plans import operations, review
from proofmill.plans.views import AS_OF_EVENTS, AS_OF_RUNS, EVENTS, run_events, runs

_FIELDS = ("metric", "key", "v", "n", "k", "cost")
_KINDS = ("string", "string", "double", "bigint", "bigint", "decimal(38,6)")
#: What a metric's value is: a number of rows, a share, money, or a percentile of the ranked values.
COUNTS = ("runs_by_status", "stuck_runs", "error_codes", "override_reasons", "trust_ratings", "findings_by_severity")
SHARES, RANKS = ("escalation_by_site", "escalation_by_trigger", "failure_rates", "override_rate"), ("run_latency", "call_latency")


def measure(metric: str, key: Column, v: Column | None = None, n: Column | None = None, k: Column | None = None, cost: Column | None = None) -> Column:
    """One measure of a row."""
    values = (F.lit(metric), key, v, F.lit(1) if n is None else n, k, cost)
    return F.struct(*((F.lit(None) if value is None else value).cast(kind).alias(name) for name, value, kind in zip(_FIELDS, values, _KINDS)))


def exploded(rows: DataFrame, measures: Column) -> DataFrame:
    """The measures of each row as rows."""
    return rows.select(F.explode(measures).alias("m")).select(*(f"m.{c}" for c in _FIELDS))


def ledger_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of runs and calls: calls grouped by four grouping sets, of which the rows by run are joined to their runs."""
    c = F.col
    columns = ("run_id", "site", "latency_ms", "trigger")
    grouped = operations.triggered(operations.priced_calls(spark, sf_dir)).groupingSets([["run_id"], ["site"], ["site", "latency_ms"], ["trigger"]], *columns).agg(
        F.grouping_id().alias("set"), F.count("*").alias("calls"), F.sum("cost").alias("cost"), F.count_if("escalated").alias("escalated"), F.count_if("changed").alias("changed"), F.count_if(c("latency_ms") % 11 == 0).alias("invalid")
    )
    # Bits of the grouping id, from the left: run, site, latency, trigger; a set bit is a column that is not of the set.
    of_site, of_latency, of_trigger = c("set") == 0b1011, (c("set") == 0b1001) & c("latency_ms").isNotNull(), (c("set") == 0b1110) & c("trigger").isin(*operations.ESCALATING)
    known = runs(spark, sf_dir).withColumnRenamed("run_id", "of_run")
    joined = known.join(grouped, c("of_run") == c("run_id"), "full")
    recent = c("started_at") >= F.lit(AS_OF_RUNS).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(operations.WINDOW_DAYS))
    stuck = c("finished_at").isNull() & ~c("status").isin(*operations.IDLE) & ~recent
    seconds = (F.unix_micros(c("finished_at").cast("timestamp")) - F.unix_micros(c("started_at").cast("timestamp"))) / 1_000_000
    month = F.concat_ws("/", "policy", F.date_format("started_at", "yyyy-MM"))
    own = c("of_run").isNotNull()
    reasons = F.transform(F.sequence(F.lit(1), F.greatest("override_count", F.lit(1))), lambda nth: measure("override_reasons", review._pick(review.REASONS, (c("of_run") + nth) % 4)))
    single = F.array(
        F.when(own & recent, measure("runs_by_status", c("status"))),
        F.when(own, measure("stuck_runs", F.lit("all"), n=stuck.cast("bigint"))),
        F.when(own & recent, measure("cost_by_policy", c("policy"), cost=c("cost"))),
        F.when(own & c("finished_at").isNotNull(), measure("run_latency", month, v=seconds)),
        F.when(own & recent, measure("failure_rates", F.lit("invalid_span"), n=F.coalesce("calls", F.lit(0)), k=F.coalesce("invalid", F.lit(0)))),
        F.when(own & (c("status") == "delivered"), measure("override_rate", c("policy"), k=(c("override_count") > 0).cast("bigint"))),
        F.when(of_site, measure("escalation_by_site", c("site"), n=c("calls"), k=c("escalated"))),
        F.when(of_trigger, measure("escalation_by_trigger", c("trigger"), n=c("calls"), k=c("changed"))),
        F.when(of_latency, measure("call_latency", c("site"), v=c("latency_ms"), n=c("calls"))),
    )
    return exploded(joined, F.concat(F.array_compact(single), F.when(own & (c("override_count") > 0), reasons).otherwise(F.array())))


def event_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of run events: errors of a week, ratings, and how long reviews took; a click stands for a review, its value for the seconds."""
    c = F.col
    recent = (c("happened") >= F.lit(AS_OF_EVENTS).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(7))) & c("kind").isNotNull()
    review_row, rating = c("kind") == "click", c("event_id") % 6
    every = F.array(
        F.when(recent, measure("error_codes", F.concat_ws("/", "kind", F.date_format("happened", "yyyy-MM-dd")))),
        F.when(review_row & (rating != 0), measure("trust_ratings", rating.cast("string"))),
        F.when(review_row & c("value").isNotNull(), measure("review_effort", F.lit("all"), v=c("value"))),
    )
    return exploded(run_events(spark, sf_dir), F.array_compact(every))


def finding_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure of each finding."""
    found = integrity.text_findings(spark, sf_dir)
    return exploded(found, F.array(measure("findings_by_severity", F.concat_ws("/", "detector", "severity"))))


def added_up(measures: DataFrame) -> DataFrame:
    """(metric, key, n, k, cost, total, p50, p95): measures grouped by metric and key; values are ranked from their counts."""
    counted = measures.groupBy("metric", "key", "v").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("cost").alias("cost"))
    group = Window.partitionBy("metric", "key")
    ranked = counted.withColumns({"upto": F.sum("n").over(group.orderBy("v")), "all": F.sum("n").over(group)})
    at = lambda f: F.min(F.when(F.col("upto") > F.bround(F.lit(f) * (F.col("all") - 1), 0), F.col("v")))
    return ranked.groupBy("metric", "key").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("cost").alias("cost"), F.sum(F.col("v") * F.col("n")).alias("total"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operational metrics in one table (metric, key, value)."""
    c = F.col
    every = ledger_measures(spark, sf_dir).unionAll(event_measures(spark, sf_dir)).unionAll(finding_measures(spark, sf_dir))
    rows = added_up(every)
    ratio = share(c("k").cast("double"), c("n"))
    value = (
        F.when(c("metric").isin(*COUNTS), c("n").cast("double"))
        .when(c("metric") == "failure_rates", F.round(ratio, 6))
        .when(c("metric").isin(*SHARES), ratio)
        .when(c("metric").isin(*RANKS), c("p95"))
        .otherwise(c("cost").cast("double"))
    )
    one = lambda key, v: F.struct(key.alias("key"), v.cast("double").alias("value"))
    effort = F.array(*(one(F.lit(name), F.round(v, 6)) for name, v in (("reviews", c("n")), ("mean_minutes", c("total") / c("n") / 60), ("median_minutes", c("p50") / 60), ("p95_minutes", c("p95") / 60))))
    lines = F.when(c("metric") == "review_effort", effort).otherwise(F.array(one(c("key"), value)))
    return rows.select("metric", F.explode(lines).alias("l")).select("metric", "l.key", "l.value")


def review_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a time, and the mean, median and 95th percentile of their minutes by nearest rank."""
    c = F.col
    row = added_up(event_measures(spark, sf_dir).where(c("metric") == "review_effort"))
    return row.select(c("n").alias("reviews"), F.round(c("total") / c("n") / 60, 6).alias("mean_minutes"), F.round(c("p50") / 60, 6).alias("median_minutes"), F.round(c("p95") / 60, 6).alias("p95_minutes"))


#: The queries whose rows a snapshot has: name, key and value as both engines read them.
PARTS = (
    ("runs_by_status", "status", "n_runs"),
    ("stuck_runs", "'all'", "count(*)"),
    ("cost_by_policy", "policy", "total_cost"),
    ("run_latency", "policy || '/' || month", "p95"),
    ("call_latency", "site", "p95"),
    ("escalation_by_site", "site", "escalation_rate"),
    ("escalation_by_trigger", "trigger", "changed_rate"),
    ("failure_rates", "'invalid_span'", "invalid_span_rate"),
    ("error_codes", "kind || '/' || day", "n_events"),
    ("override_rate", "policy", "rate"),
    ("override_reasons", "reason", "n"),
    ("trust_ratings", "rating", "n"),
    ("findings_by_severity", "detector || '/' || severity", "n"),
)
_EFFORT = f"""WITH {EVENTS}, s AS (SELECT list_sort(list(value)) AS v FROM run_events WHERE kind = 'click' AND value IS NOT NULL)
    SELECT len(v)::BIGINT AS reviews, round(list_sum(v) / len(v) / 60, 6) AS mean_minutes, round(v[round_even(0.5 * (len(v) - 1), 0)::INT + 1] / 60, 6) AS median_minutes, round(v[round_even(0.95 * (len(v) - 1), 0)::INT + 1] / 60, 6) AS p95_minutes FROM s WHERE len(v) > 0"""


def _parts() -> str:
    # A snapshot looks back as far for costs as for its other metrics of runs.
    recent = operations.cost_sql(f" WHERE started_at >= TIMESTAMP '{AS_OF_RUNS}' - INTERVAL {operations.WINDOW_DAYS} DAY")
    known = {**operations.QUERIES, **review.QUERIES, "cost_by_policy": (operations.cost_by_policy, recent)}
    parts = [f"(SELECT '{name}' AS metric, CAST({key} AS STRING) AS key, CAST({value} AS DOUBLE) AS value FROM ({known[name][1]}))" for name, key, value in PARTS]
    parts += [f"(SELECT 'review_effort', '{name}', {name}::DOUBLE FROM ({_EFFORT}))" for name in ("reviews", "mean_minutes", "median_minutes", "p95_minutes")]
    return " UNION ALL ".join(parts)


QUERIES = {"snapshot": (snapshot, _parts()), "review_effort": (review_effort, _EFFORT)}
