"""Benchmark decontamination by spaced-seed hashing.

A mask names the places of a span whose words are hashed; the others may differ. Every place of every document
and of every benchmark item is hashed with each mask, equal hashes are joined, and around each hit the item is
laid over the document without gaps: enough equal words in some stretch make a leak. The masks are such that every
leak has a hit, whichever words were exchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm import scratch
from proofmill.llm.sharing import within
from proofmill.llm.words import split_words

#: What lies between words: runs of letters, digits and characters beyond ASCII, of lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed masks: places of a span of at most 7 words. Any two exchanged words of 13 leave one of them whole somewhere.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6))
#: Masks that items of ``WHOLE`` to ``STRETCH`` - 1 words need besides, for every pattern that their threshold allows.
MORE_MASKS = ((0, 1, 2, 4, 6), (0, 1, 2, 5, 6))
#: A leak is a stretch of so many words, or a whole shorter item, of which this share is equal.
STRETCH, SIMILARITY = 13, 0.8
#: Items of fewer words have to stand unchanged; their mask is the whole item.
WHOLE = 7
#: Benchmark hashes that are broadcast at most; beyond that documents and hashes are shuffled.
BROADCAST_SEEDS = 1 << 21


def words_of(text: Column) -> Column:
    return split_words(F.lower(F.coalesce(text, F.lit(""))), GAP)


def masks_for(size: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of ``size`` words."""
    if size < WHOLE:
        return (tuple(range(size)),)
    return MASKS if size >= STRETCH else MASKS + MORE_MASKS


def seeds(rows: DataFrame, keys: list[str], masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """``keys``, (at, seed): a hash for each place of ``words`` and each mask that fits there.

    Each place becomes a row with the codes of the words from it on, so hashing is compiled code and not a lambda.
    """
    span = 1 + max(mask[-1] for mask in masks)
    rows = rows.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("w0"))
    ahead = [F.slice("w0", k + 1, F.greatest(F.size("w0") - k, F.lit(0))).alias(f"w{k}") for k in range(1, span)]
    places = rows.select(*keys, F.posexplode(F.arrays_zip("w0", *ahead)).alias("at", "w")).select(*keys, "at", *(F.col(f"w.w{k}").alias(f"w{k}") for k in range(span)))

    def hashed(mask: tuple[int, ...]) -> Column:
        number = (MASKS + MORE_MASKS).index(mask) if mask in MASKS + MORE_MASKS else 100 + len(mask)
        return F.when(F.col(f"w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(number), *(F.col(f"w{k}") for k in mask)))

    return places.select(*keys, "at", F.explode(F.array(*map(hashed, masks))).alias("seed")).where(F.col("seed").isNotNull())


def aligned(hits: DataFrame) -> DataFrame:
    """Add n_words, n_equal and ``best`` (most equal words of a stretch) to rows (words, item_words, start)."""
    equal = F.transform(F.sequence(F.lit(0), F.size("item_words") - 1), lambda k: F.when(F.get("words", F.col("start") + k) == F.get("item_words", k), 1).otherwise(0))
    rows = hits.withColumn("equal", equal).withColumn("n_words", F.size("item_words"))
    stretch = F.least(F.lit(STRETCH), F.col("n_words"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n_words") - stretch + 1), lambda s: total(F.slice("equal", s, stretch))))
    return rows.withColumns({"n_equal": total(F.col("equal")), "best": best, "needed": F.when(F.col("n_words") < WHOLE, F.col("n_words")).otherwise(F.ceil(stretch * F.lit(SIMILARITY)))})


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, start, n_words, n_equal, similarity): for each document and item that it leaks the best place.

    ``start`` is the document's word, from 0, on which the item's first word falls (negative if the item's start
    is missing). Items without a word, nulls among them, leak nothing; items of fewer than 7 words have to stand
    unchanged; rows equal in id and text give one row; a null id is kept. Ties go to the earliest place. No item or no
    document: no rows.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    kind = F.when(F.size("words") >= STRETCH, STRETCH).when(F.size("words") >= WHOLE, WHOLE).otherwise(F.size("words"))
    kinds = sorted(r["kind"] for r in items.select(kind.alias("kind")).distinct().collect())
    if not kinds:
        return docs.select(F.col(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("item_id", benchmark.schema["item_id"].dataType), ("start", "long"), ("n_words", "long"), ("n_equal", "long"), ("similarity", "double")))).where("false")
    used = tuple(dict.fromkeys(mask for k in kinds for mask in masks_for(k)))
    index = reduce(DataFrame.unionAll, (seeds(items.where(kind == k), ["item_id"], masks_for(k)) for k in kinds))
    index = index.distinct().select("item_id", F.col("at").alias("item_at"), "seed")
    few = index.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    texts = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    keyed = lambda rows: rows.select("own", "hash", words_of(F.col("text")).alias("words"))
    hits = seeds(keyed(texts), ["own", "hash"], used).join(F.broadcast(index) if few else index, "seed")
    hits = hits.select(F.col("own").alias("hit_own"), F.col("hash").alias("hit_hash"), "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct()
    hits = scratch.materialize(hits, "hits")
    # Only texts with a hit are cut into words again and shuffled.
    some = within(F.col("hash"), hits.select(F.col("hit_hash").alias("id")).distinct())(texts)
    there = F.col("own").eqNullSafe(F.col("hit_own")) & (F.col("hash") == F.col("hit_hash"))
    placed = hits.join(items.select("item_id", F.col("words").alias("item_words")), "item_id").join(keyed(some), there)
    leaks = aligned(placed).where(F.col("best") >= F.col("needed"))
    best = leaks.groupBy("own", "item_id").agg(F.max_by(F.struct("start", "n_words", "n_equal"), F.struct("n_equal", (-F.col("start")).alias("early"))).alias("b"))
    similarity = F.col("b.n_equal") / F.col("b.n_words")
    counts = [F.col(f"b.{c}").cast("long").alias(c) for c in ("start", "n_words", "n_equal")]
    return best.select(F.col("own").alias(id_col), "item_id", *counts, similarity.alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id leaks no item; all of their columns, whatever the names, and repeated rows stay."""
    leaking = scratch.materialize(find_leaks(docs, benchmark).select(F.col("doc_id").alias("leaking")).distinct(), "leaking")
    return docs.join(leaking, docs["doc_id"].eqNullSafe(leaking["leaking"]), "left_anti")
