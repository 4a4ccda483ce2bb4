"""Importance resampling towards a target distribution, by a table of word positions.

Words are exploded with their positions; for orders above one a window over each document adds the words that follow,
``lead()`` by one, two and so on, and each order's run is their concatenation. Runs are hashed into buckets, counted by
bucket in both corpora, and the bucket's gain (the log ratio of its shares) is joined back and summed by document.
Gumbel noise of the id turns the weights into scores whose highest are the draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm import scratch
from proofmill.llm.words import split_words

#: What lies between words: ASCII other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Orders of the runs, buckets, percentage drawn, least words of a document that can be drawn, and the noise's seed.
ORDERS, BUCKETS, PERCENT, LEAST_WORDS, SEED = (1, 1), 10_000, 10, 20, 2024
#: ``monotonically_increasing_id`` has the partition above this bit and the row's place in it below.
_PLACE_BITS = 33


def lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does just that to words of ASCII and is compiled code."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, (at, word): a row for each word of ``text``, and one with nulls for a text without a word."""
    words = split_words(F.coalesce(F.col("text"), F.lit("")), GAP)
    return rows.select(*keys, F.posexplode_outer(words).alias("at", "raw")).select(*keys, "at", lowered(F.col("raw")).alias("word"))


def features(table: DataFrame, keys: list[str], orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``keys``, (at, bucket) of a table of positions: a row for each run, and one without a bucket for a text without a word.

    ``at`` is null but for the run of the first order that begins at a word, so that counting it counts words. The
    window is dealt by the first of ``keys``, which must tell rows apart; with single words there is nothing to look
    ahead for and no shuffle.
    """
    first, last = orders
    by_row = Window.partitionBy(keys[0]).orderBy("at")
    ahead = {f"w{k}": F.lead("word", k).over(by_row) for k in range(1, last)}
    table = table.withColumns(ahead) if ahead else table
    words = [F.col("word"), *(F.col(c) for c in ahead)]

    def bucket(order: int) -> Column:
        run = F.concat_ws(" ", *words[:order]) if order > 1 else words[0]
        return F.when(words[order - 1].isNotNull(), F.crc32(run) % buckets)

    if first == last == 1:
        return table.select(*keys, "at", bucket(1).alias("bucket"))
    runs = F.array(*(F.struct(F.when(F.lit(order == first), F.col("at")).alias("at"), bucket(order).alias("bucket")) for order in range(first, last + 1)))
    # The first order's row stays even if no run begins there, as it counts the word.
    kept = F.filter(runs, lambda r: r["bucket"].isNotNull() | r["at"].isNotNull())
    return table.select(*keys, F.explode_outer(kept).alias("r")).select(*keys, "r.at", "r.bucket")


def bucket_counts(rows: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts of ``rows`` (row, text); at most ``buckets`` rows, summed in each task before the shuffle."""
    found = features(positions(rows, ["row"]), ["row"], orders, buckets).where(F.col("bucket").isNotNull())
    return found.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln) of the target's smoothed share over the source's."""
    spark = source.sparkSession
    s, t = (bucket_counts(rows, orders, buckets).withColumnRenamed("n", name) for rows, name in ((source, "s"), (target, "t")))
    every = spark.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    counts = scratch.materialize(every, "buckets")
    number = lambda c: F.col(c).cast("double")
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (number("t") + 1) * (number("all_s") + buckets) / ((number("s") + 1) * (number("all_t") + buckets))
    return counts.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) of the id's number u in (0, 1), the same at each run; a null id hashes as none."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank`` (1, 2, 3...) by falling ``score``, ties to the smaller ``doc_id``, nulls last.

    Rows are dealt by ranges of both, sorted in their tasks and numbered there; what goes before each range is the sum of
    the ranges' sizes, a row for each. No task sees all rows, whatever scores are tied.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = scratch.materialize(placed, "ranges").withColumn("range", F.shiftright("place", _PLACE_BITS))
    before = F.sum("many").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy(F.col("range").alias("of")).agg(F.count("*").alias("many")).select("of", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return placed.join(F.broadcast(sizes), F.col("range") == F.col("of")).select(*rows.columns, (nth + F.col("before") + 1).alias("rank"))


def importance_draw(
    docs: DataFrame, target: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs``; ``rank`` is null for what is not drawn.

    ``docs`` needs doc_id and text, ``target`` text; other columns are ignored whatever their names. Null and empty texts
    have no words, a weight of 0, and are never drawn. Repeated rows and rows with a null id are ranked one by one; a null
    id stands behind ties. Texts are read whole. An empty ``docs`` gives no rows; an empty ``target`` has a share of
    1 / ``buckets`` in each. Rows are numbered by their partition, so ``docs`` should be a table that is read alike again.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = target.select(F.monotonically_increasing_id().alias("row"), "text")
    gain = gains(rows, wanted, orders, buckets)
    found = features(positions(rows, ["row", "doc_id"]), ["row", "doc_id"], orders, buckets).join(F.broadcast(gain), "bucket", "left")
    weights = found.groupBy("row", "doc_id").agg(
        F.count("bucket").alias("n_features"), F.count("at").alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight")
    )
    scored = scratch.materialize(weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).drop("row"), "scores")
    columns = ["doc_id", "n_features", "weight", "score"]
    able = scored.where(F.col("n_words") >= least_words).select(*columns)
    drawn = able.count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(able).select(*columns, rank).unionAll(rest)
