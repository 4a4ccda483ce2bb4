"""An idempotent sink for streams: each batch is written once, each run is delivered once, failures are classed and tried again.

The outcomes of a batch are a folder named by its number, so a batch that comes again is recognised; runs that an earlier batch
delivered are left out by an anti join. The calls are made by the tasks, within a rate that the batch's tasks share; what is left of the
rate's bucket is state that the next batch takes up.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.sources.remote import ATTEMPTS, RETRYABLE, backoff, failure_class

OUTCOME = "run_id bigint, ok boolean, failure string, attempts int, waited double"
BUCKET = "batch bigint, tokens double, at double"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def taken(tokens: float, rate: float, calls: int) -> tuple[list[float], float]:
    """Seconds that each of ``calls`` made one after another waits for a token, and the tokens left; without a rate none waits."""
    if rate <= 0:
        return [0.0] * calls, tokens
    waits = []
    for _ in range(calls):
        waits.append(max(0.0, 1.0 - tokens) / rate)
        tokens = max(0.0, tokens - 1.0)
    return waits, tokens


def refilled(tokens: float, since: float, now: float, rate: float, capacity: float) -> float:
    """The bucket after the time between two batches."""
    return min(capacity, tokens + max(0.0, now - since) * rate)


def call_once(send: Callable[[dict], int], row: dict, seed: int, sleep: Callable[[float], None]) -> tuple[bool, str | None, int, float]:
    """(delivered, class of the failure, attempts, seconds waited) of one row; ``send`` returns a status or raises, which is no answer."""
    rng, waited, failure = random.Random(seed), 0.0, None
    for attempt in range(1, ATTEMPTS + 1):
        try:
            status = send(row)
        except Exception as error:
            status = getattr(error, "status", None)
        if status is not None and status < 400:
            return True, None, attempt, waited
        failure = failure_class(status)
        if failure not in RETRYABLE or attempt == ATTEMPTS:
            return False, failure, attempt, waited
        delay = backoff(attempt, rng)
        waited += delay
        sleep(delay)
    raise AssertionError


def outcomes_of(spark: SparkSession, path: str) -> DataFrame:
    """All outcomes below ``path``, with their batch."""
    if not exists(spark, f"{path}/outcomes"):
        return spark.createDataFrame([], f"{OUTCOME}, batch bigint")
    return spark.read.schema(f"{OUTCOME}, batch bigint").parquet(f"{path}/outcomes")


def bucket_of(spark: SparkSession, path: str, before: int) -> tuple[float, float] | None:
    """(tokens, at) that the last batch before ``before`` left; one row a batch."""
    if not exists(spark, f"{path}/bucket"):
        return None
    row = spark.read.schema(BUCKET).option("recursiveFileLookup", "true").parquet(f"{path}/bucket").where(F.col("batch") < before).agg(F.max(F.struct("batch", "tokens", "at")).alias("b")).first()["b"]
    return (row["tokens"], row["at"]) if row else None


def deliver(
    rows: DataFrame, batch: int, path: str, send: Callable[[dict], int], seed: int = 0, rate: float = 0.0, capacity: float = 0.0,
    now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Send each run of ``rows`` (run_id, ...) that no earlier batch delivered, once; returns the outcomes of the batch.

    A batch whose folder is complete is not sent again. One that was cut off is: its runs are told apart by ``run_id`` on the other side.
    Rows of one run in a batch are one delivery; a null run is none. ``send`` is called in the tasks with the row as a dictionary.
    The rate is shared by the tasks; ``capacity`` is that of the bucket, the rate's by default.
    """
    spark = rows.sparkSession
    own = f"{path}/outcomes/batch={batch}"
    if exists(spark, f"{own}/_SUCCESS"):
        return spark.read.schema(OUTCOME).parquet(own)
    done = outcomes_of(spark, path).where(F.col("ok") & (F.col("batch") != batch)).select("run_id").distinct()
    fresh = rows.where(F.col("run_id").isNotNull()).dropDuplicates(["run_id"]).join(done, "run_id", "left_anti")
    size, began = capacity or max(rate, 1.0), now()
    left = bucket_of(spark, path, batch)
    tokens = refilled(*left, began, rate, size) if left else size
    parts = max(spark.sparkContext.defaultParallelism, 1)
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = tokens / parts
        for batch_rows in batches:
            waits, mine = taken(mine, rate / parts, len(batch_rows))
            out = []
            for wait, values in zip(waits, batch_rows[names].itertuples(index=False)):
                row = dict(zip(names, values))
                if wait:
                    sleep(wait)
                ok, failure, attempts, waited = call_once(send, row, hash((seed, int(row["run_id"]))), sleep)
                out.append((row["run_id"], ok, failure, attempts, wait + waited))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    fresh.repartition(parts, "run_id").mapInPandas(run, OUTCOME).write.mode("overwrite").parquet(own)
    outcomes = spark.read.schema(OUTCOME).parquet(own)
    calls = outcomes.agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("n")).first()["n"]
    after = taken(tokens, rate, 0)[1] if rate <= 0 else max(0.0, tokens - calls)
    spark.createDataFrame([(batch, float(after), float(began))], BUCKET).write.mode("overwrite").parquet(f"{path}/bucket/batch_{batch}")
    return outcomes


def sink(path: str, send: Callable[[dict], int], **options) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``."""
    return lambda rows, batch: deliver(rows, batch, path, send, **options) and None
