"""Removal of repeated word windows by prefix-partitioned suffix trees.

A suffix is the text from one word on. The suffixes are dealt to tasks by prefixes of variable length: by the first
``EDGES[0]`` words, and by the next ``EDGES[1]`` where a prefix has more suffixes than a task should hold. A task sorts
its suffixes, which is walking its subtrees in order: neighbours that agree in both edges share an inner node of depth
``WINDOW``, whose leftmost leaf is the first occurrence and whose other leaves repeat it. Deeper nodes are reached by
suffix links: if the suffixes one word on share a node too, the common prefix is one word longer. Following the links
as far as they go gives the maximal repeats, with their length and both places. Nodes are found by codes of words; the
words of each repeat are digested on both sides and compared before they count.

Only suffixes whose window can occur twice enter the trees. Of the 6-word codes in a window the least one is
its anchor, and equal windows have equal anchors; an anchor seen once in the corpus rules its windows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm import scratch
from proofmill.llm.sharing import by_slices, shared_rows, within
from proofmill.llm.words import codes_of, grams

WINDOW, ANCHOR = 20, 6
#: Words of each edge.
EDGES = (6, 14)
#: Suffixes of one prefix that a task gets at most, about 3 MB.
GROUP_ROWS = 1 << 16
_NONE = np.empty(0, dtype=np.uint64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _each(texts: list[str | None]) -> Iterator[np.ndarray]:
    codes, bounds = codes_of([_bytes(t) for t in texts])
    return (codes[lo:hi] for lo, hi in zip(bounds, bounds[1:]))


def window_anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``ANCHOR`` consecutive words, and for each window the least of those in it."""
    small = grams(codes, ANCHOR)
    width, low, span = WINDOW - ANCHOR + 1, small, 1
    if len(small) < width:
        return small, _NONE
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    rest = width - span
    return small, np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def word_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, digest): SHA-256 of the words joined by one space."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [_bytes(t).split() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary())],
            ["doc_id", "n_words", "digest"],
        )

    return docs.select("doc_id", "text").mapInArrow(lambda batches: by_slices(batches, make), "doc_id bigint, n_words bigint, digest binary")


def anchors(docs: DataFrame) -> DataFrame:
    """(h, n, rep): the anchors of each document, with the number of places they have in it."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, counts, long = [_NONE], [np.empty(0, dtype=np.int64)], []
        for words in _each(batch.column("text").to_pylist()):
            small, least = window_anchors(words)
            found, n = np.unique(small[np.isin(small, least)], return_counts=True) if len(least) else (_NONE, np.empty(0, dtype=np.int64))
            codes.append(found)
            counts.append(n)
            long.append(len(found))
        ids = np.repeat(np.array(batch.column("doc_id").to_pylist(), dtype=np.int64), long)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes).view(np.int64)), pa.array(np.concatenate(counts)), pa.array(ids)], ["h", "n", "rep"])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: by_slices(batches, make), "h bigint, n bigint, rep bigint")


def suffixes(docs: DataFrame) -> DataFrame:
    """(p1, p2, doc, at): paths of the suffixes of rows (doc_id, text, keys) whose window has an anchor in ``keys``."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        paths, docs, places = [[_NONE] for _ in EDGES], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        keys = batch.column("keys").to_pylist()
        for doc, wanted, words in zip(batch.column("doc_id").to_pylist(), keys, _each(batch.column("text").to_pylist())):
            _, least = window_anchors(words)
            at = np.flatnonzero(np.isin(least, np.array(wanted, dtype=np.int64).view(np.uint64)))
            start = 0
            for path, length in zip(paths, EDGES):
                path.append(grams(words, length)[at + start] if len(at) else _NONE)
                start += length
            docs.append(np.full(len(at), doc, dtype=np.int64))
            places.append(at)
        columns = [*(np.concatenate(p).view(np.int64) for p in paths), np.concatenate(docs), np.concatenate(places)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["p1", "p2", "doc", "at"])

    return docs.select("doc_id", "text", "keys").mapInArrow(lambda batches: by_slices(batches, make), "p1 bigint, p2 bigint, doc bigint, at bigint")


def dealt(rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The suffixes with ``key``, a prefix that few enough share, and ``split``: whether even equal windows were parted."""
    heavy, at = rows, []
    for level in range(len(EDGES)):
        keys = ["p1", "p2"][: level + 1]
        counts = heavy.groupBy(*keys).agg(F.count("*").alias("many")).where(F.col("many") > group_rows)
        counts = scratch.materialize(counts.withColumnRenamed("many", f"many{level}"), f"heavy-{level}")
        at.append((keys, counts))
        heavy = heavy.join(counts, keys, "left_semi")
    for keys, counts in at:
        # At most one prefix in ``group_rows`` suffixes is heavy; Spark broadcasts the table if it is small.
        rows = rows.join(counts, keys, "left")
    parts = F.xxhash64("p1", "p2", F.pmod(F.xxhash64("doc"), F.ceil(F.col("many1") / group_rows)))
    key = F.when(F.col("many0").isNull(), F.xxhash64("p1")).when(F.col("many1").isNull(), F.xxhash64("p1", "p2")).otherwise(parts)
    return rows.select("p1", "p2", "doc", "at", key.alias("key"), F.col("many1").isNotNull().alias("split"))


def repeated_leaves(rows: DataFrame) -> DataFrame:
    """(doc, at, of_doc, of_at) of each window that occurs earlier, with an earlier place: the leftmost leaf of its node.

    Equal leaves (doc, at), of a row that is there twice, are one leaf.
    """
    names = ["p1", "p2", "doc", "at", "of_doc", "of_at"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            split = batch.column("split").to_numpy(zero_copy_only=False)
            leaf = np.stack([batch.column(c).to_numpy() for c in names[:4]])
            equal = leaf == np.concatenate((leaf[:, :1] if last is None else last, leaf[:, :-1]), axis=1)
            same, twice = equal[:2].all(axis=0), equal.all(axis=0)
            if last is None:
                same[0] = twice[0] = False
            # The leftmost leaf of each node; that of the first one may be in an earlier batch.
            begin = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
            of = np.where(begin < 0, leaf[2:, :1] if first is None else first, leaf[2:, np.maximum(begin, 0)])
            last, first = leaf[:, -1:], of[:, -1:]
            keep = (same | split) & ~twice
            arrays = [pa.array(np.where(split, leaf[0], 0)), pa.array(np.where(split, leaf[1], 0)), *map(pa.array, (*leaf[2:], *of)), pa.array(~same)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "first"]).filter(pa.array(keep))

    sorted_rows = rows.repartition("key").sortWithinPartitions("p1", "p2", "doc", "at")
    schema = ", ".join(f"{c} bigint" for c in names) + ", first boolean"
    leaves = scratch.materialize(sorted_rows.select("p1", "p2", "doc", "at", "split").mapInArrow(walk, schema), "leaves")
    # A window over the limit was parted by document: of the first leaves of its parts, few, one is the first of all.
    every = Window.partitionBy("p1", "p2").orderBy("doc", "at")
    firsts = leaves.where("first").withColumns({"of_doc": F.first("doc").over(every), "of_at": F.first("at").over(every), "nth": F.row_number().over(every)}).where("nth > 1")
    return leaves.where("not first").select(*names[2:]).unionAll(firsts.select(*names[2:]))


def maximal_repeats(leaves: DataFrame) -> DataFrame:
    """(doc, start, of_doc, of_start, length): leaves joined by their suffix links, as many words as both places agree."""
    names = ["doc", "start", "of_doc", "of_start", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, at, of_doc, of_at = (batch.column(c).to_numpy() for c in ("doc", "at", "of_doc", "of_at"))
            rows = np.stack((doc, at, of_doc, of_at, np.full(len(doc), WINDOW, dtype=np.int64)))
            rows = rows if held is None else np.concatenate((held, rows), axis=1)
            a, b = rows[:, :-1], rows[:, 1:]
            # A held repeat ends ``length`` - WINDOW + 1 windows after its start.
            on = (a[0] == b[0]) & (a[2] == b[2]) & (b[1] - a[1] == a[4] - WINDOW + 1) & (b[3] - a[3] == a[4] - WINDOW + 1)
            starts = np.flatnonzero(np.concatenate(([True], ~on)))
            joined = rows[:, starts]
            joined[4] = np.add.reduceat(rows[4] - WINDOW + 1, starts) + WINDOW - 1
            held = joined[:, -1:]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in joined[:, :-1]], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)

    rows = leaves.repartition("doc").sortWithinPartitions("doc", "of_doc", F.col("at") - F.col("of_at"), "at")
    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def span_digests(docs: DataFrame) -> DataFrame:
    """(doc, start, length, digest) of each of ``spans``, an array of (start, length), of rows (doc_id, text, spans)."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
            words = _bytes(text).split()
            out += [(doc, s["start"], s["length"], hashlib.sha256(b" ".join(words[s["start"] : s["start"] + s["length"]])).digest()) for s in spans]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["doc", "start", "length", "digest"])

    return docs.select("doc_id", "text", "spans").mapInArrow(lambda batches: by_slices(batches, make), "doc bigint, start bigint, length bigint, digest binary")


def verified(repeats: DataFrame, docs: DataFrame) -> DataFrame:
    """The repeats whose words are the same at both places. Of a document distinct spans are digested once, however many repeat them."""
    sides = repeats.select("doc", "start", "length").unionAll(repeats.select("of_doc", "of_start", "length")).distinct()
    spans = scratch.materialize(sides.groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("spans")), "spans")
    some = within(F.col("doc_id"), spans.select(F.col("doc").alias("id")))(docs).join(spans, F.col("doc_id") == F.col("doc"))
    digests = scratch.materialize(span_digests(some).distinct(), "span-digests")
    there = digests.select(F.col("doc").alias("of_doc"), F.col("start").alias("of_start"), "length", F.col("digest").alias("of_digest"))
    return repeats.join(digests, ["doc", "start", "length"]).join(there, ["of_doc", "of_start", "length"]).where(F.col("digest") == F.col("of_digest")).select(repeats.columns)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_removed, kept, kept_text) of rows (doc_id, text, spans): words of the spans (start, length) go."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, kept, texts = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = _bytes(text).split()
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, np.array([s["start"] for s in spans]), 1)
            np.add.at(change, np.array([s["start"] + s["length"] for s in spans]), -1)
            gone = np.cumsum(change[:-1]) > 0
            rest = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            removed.append(int(gone.sum()))
            kept.append(hashlib.sha256(rest).digest())
            texts.append(rest.decode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "n_removed", "kept", "kept_text"])

    return docs.select("doc_id", "text", "spans").mapInArrow(lambda batches: by_slices(batches, make), "doc_id bigint, n_removed bigint, kept binary, kept_text string")


def own_repeats(words: list[bytes], codes: np.ndarray) -> np.ndarray:
    """Which words of one text a window covers that stands in the text before; windows of equal code are compared word by word."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    windows = grams(codes, WINDOW)
    _, first, number = np.unique(windows, return_index=True, return_inverse=True)
    for at in np.flatnonzero(first[number] != np.arange(len(windows))).tolist():
        of = int(first[number[at]])
        if words[at : at + WINDOW] == words[of : of + WINDOW]:
            change[at] += 1
            change[at + WINDOW] -= 1
    return np.cumsum(change[:-1]) > 0


def without_own_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_removed, kept) of rows (doc_id, text), each judged by its own text alone; ``digest`` is that of all its words."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = batch.column("text").to_pylist(), []
        for text, codes in zip(texts, _each(texts)):
            words = _bytes(text).split()
            gone = own_repeats(words, codes)
            rest = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            out.append((hashlib.sha256(b" ".join(words)).digest(), int(gone.sum()), hashlib.sha256(rest).digest()))
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "digest", "n_removed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: by_slices(batches, make), "doc_id bigint, digest binary, n_removed bigint, kept binary")


def find_repeats(docs: DataFrame, digests: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc, start, of_doc, of_start, length): maximal repeats in the documents of ``digests`` (doc_id, ...), all texts different."""
    some = within(F.col("doc_id"), digests.select(F.col("doc_id").alias("id")).distinct())(docs)
    shared = scratch.materialize(shared_rows(anchors(some), alone=2).groupBy("rep").agg(F.collect_list("h").alias("keys")), "anchors")
    near = within(F.col("doc_id"), shared.select(F.col("rep").alias("id")))(docs).join(shared, F.col("doc_id") == F.col("rep"))
    paths = scratch.materialize(suffixes(near), "suffixes")
    repeats = scratch.materialize(maximal_repeats(repeated_leaves(dealt(paths, group_rows))), "repeats")
    return verified(repeats, docs)


def remove_repeats(docs: DataFrame, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row of ``docs``.

    Of documents with equal words all but the one with the smallest id lose every word if they have a window at
    all, so only that one enters the trees. Null text has no words. Rows equal in id and words are one document. A
    row with a null id, or with an id that has rows of other words too, has no place among the documents: it loses the
    repeats inside its own text and takes no words from others. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digests = scratch.materialize(word_digests(docs), "words")
    words = F.xxhash64("digest")
    unclear = digests.groupBy("doc_id").agg(F.min(words).alias("low"), F.max(words).alias("high")).where(F.col("low") != F.col("high"))
    unclear = scratch.materialize(unclear.select(F.col("doc_id").alias("unclear")), "unclear")
    known = digests.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW)).join(unclear, F.col("doc_id") == F.col("unclear"), "left_anti")
    firsts = scratch.materialize(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "firsts")
    repeats = find_repeats(docs, firsts.select(F.col("rep").alias("doc_id")), group_rows)
    spans = repeats.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    spans = scratch.materialize(spans, "removed")
    some = within(F.col("doc_id"), spans.select(F.col("doc_id").alias("id")))(docs).join(spans, "doc_id")
    cut = without_repeats(some).select(F.col("doc_id").alias("cut_id"), "n_removed", "kept").dropDuplicates(["cut_id"])
    apart = docs.join(unclear, F.col("doc_id") == F.col("unclear"), "left").where(F.col("doc_id").isNull() | F.col("unclear").isNotNull())
    # What a text loses by itself hangs on its words alone.
    own = without_own_repeats(apart).groupBy("digest").agg(F.max("n_removed").alias("own_removed"), F.max("kept").alias("own_kept"))
    placed = digests.join(firsts, "digest", "left").join(cut, F.col("doc_id") == F.col("cut_id"), "left").join(unclear, F.col("doc_id") == F.col("unclear"), "left")
    placed = placed.join(own, "digest", "left")
    alone = F.col("doc_id").isNull() | F.col("unclear").isNotNull()
    copy = F.col("rep").isNotNull() & F.col("doc_id").isNotNull() & F.col("unclear").isNull() & (F.col("doc_id") != F.col("rep"))
    nothing = F.unhex(F.sha2(F.lit(""), 256))
    return placed.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).when(alone, F.col("own_removed")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(F.when(copy, nothing).when(alone, F.col("own_kept")).otherwise(F.coalesce("kept", "digest")))).alias("kept_sha256"),
    )
