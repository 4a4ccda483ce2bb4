"""The run ledger as views over the input tables.

Orders stand for runs, their lines for model calls, events for the run events, and customers for candidates.
All operators take frames of these columns, so any other ledger of the same columns does as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.tables import read_table

#: The moment that "now" means in every query: nothing reads a clock.
AS_OF_RUNS, AS_OF_EVENTS = "2001-08-02 00:00:00", "2024-01-31 00:00:00"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, candidate, status, policy, started_at, finished_at, override_count, version."""
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("candidate"),
        F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderkey") % 3 == 0, "structured").when(F.col("o_orderkey") % 3 == 1, "needs_review").otherwise("assessed").alias("status"),
        F.col("o_orderpriority").alias("policy"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 40 + 1).cast("int"))).alias("finished_at"),
        F.when(F.col("o_orderkey") % 11 == 0, (F.col("o_orderkey") % 4).cast("int")).otherwise(0).alias("override_count"),
    )


RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS candidate,
    CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderkey % 3 = 0 THEN 'structured' WHEN o_orderkey % 3 = 1 THEN 'needs_review' ELSE 'assessed' END AS status,
    o_orderpriority AS policy, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours((o_orderkey % 40 + 1)::INT) END AS finished_at,
    CASE WHEN o_orderkey % 11 = 0 THEN (o_orderkey % 4)::INT ELSE 0 END AS override_count FROM orders)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, call_no, site, tier, input_tokens, output_tokens, cached_tokens, latency_ms, escalated, changed, retries."""
    tokens = F.col("l_quantity").cast("bigint")
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("call_no"),
        F.when(F.col("l_returnflag") == "A", "assess").when(F.col("l_returnflag") == "N", "structure").otherwise("compose").alias("site"),
        F.when(F.col("l_partkey") % 10 == 0, "local").when(F.col("l_linestatus") == "F", "strong").otherwise("cheap").alias("tier"),
        (tokens * 100).alias("input_tokens"),
        (tokens * 7).alias("output_tokens"),
        (tokens * (F.col("l_suppkey") % 120)).alias("cached_tokens"),
        (F.col("l_partkey") % 997 + tokens).alias("latency_ms"),
        (F.col("l_discount") > 0.075).alias("escalated"),
        (F.col("l_tax") > 0.045).alias("changed"),
        (F.col("l_suppkey") % 3 == 0).alias("retried"),
        F.col("l_shipdate").alias("shipped"),
    )


CALLS = """calls AS (SELECT l_orderkey AS run_id, l_linenumber AS call_no, CASE l_returnflag WHEN 'A' THEN 'assess' WHEN 'N' THEN 'structure' ELSE 'compose' END AS site,
    CASE WHEN l_partkey % 10 = 0 THEN 'local' WHEN l_linestatus = 'F' THEN 'strong' ELSE 'cheap' END AS tier,
    l_quantity::BIGINT * 100 AS input_tokens, l_quantity::BIGINT * 7 AS output_tokens, l_quantity::BIGINT * (l_suppkey % 120) AS cached_tokens,
    l_partkey % 997 + l_quantity::BIGINT AS latency_ms, l_discount > 0.075 AS escalated, l_tax > 0.045 AS changed, l_suppkey % 3 = 0 AS retried, l_shipdate AS shipped FROM lineitem)"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, event_id, happened, kind, value."""
    return read_table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").alias("happened"), F.col("event_type").alias("kind"), "value")


EVENTS = "run_events AS (SELECT user_id AS run_id, event_id, ts AS happened, event_type AS kind, value FROM events)"

#: Prices of a million tokens by tier: input, output, cached. A tier without a row is unpriced.
PRICES = (("cheap", "1.000000", "5.000000", "0.100000"), ("strong", "3.000000", "15.000000", "0.300000"))
PRICES_SQL = "prices(tier, p_in, p_out, p_cached) AS (VALUES " + ", ".join(f"('{t}', {a}::DECIMAL(18,6), {b}::DECIMAL(18,6), {c}::DECIMAL(18,6))" for t, a, b, c in PRICES) + ")"


def prices(spark: SparkSession) -> DataFrame:
    money = "decimal(18,6)"
    rows = spark.createDataFrame([*PRICES], "tier string, a string, b string, c string")
    return rows.select("tier", F.col("a").cast(money).alias("p_in"), F.col("b").cast(money).alias("p_out"), F.col("c").cast(money).alias("p_cached"))
