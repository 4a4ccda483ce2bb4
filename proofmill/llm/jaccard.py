"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct shingles; equal sets are one class. Two linked sets miss at most
n - ceil(0.85 n) of each other's shingles, so a set that has more shingles which no other class has links with
nothing. Those sets, most of a corpus, go first: half of all shingle codes are counted once, packed by bucket.

What is left is counted exactly and ordered from rare shingles to common ones. Sets meet in a block where they share
one of their first n - ceil(0.85 n) + 1 shingles in that order. In a block each set is a point: its shared shingles
hashed into groups and counted by group. The sum over groups of the smaller count bounds the overlap of two sets from
above, and so do the shingles from the common one on. The points are packed into an R-tree, and pairs of nodes, then
of points, that cannot reach the threshold by the bounds fall away. What is left is checked exactly.

Only components are asked for, so pairs are checked in two rounds: neighbours in each block first, in an order that
differs between blocks, and each with the block's most ordinary set; then all pairs whose sets are not in one
component yet. A group of thousands of near copies thus costs about as many comparisons as it has members, and no
link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm import scratch
from proofmill.llm.components import components
from proofmill.llm.sharing import BROADCAST_ROWS, SLICE_ROWS, ended
from proofmill.llm.words import codes_of, grams, mix

WORDS, NUMERATOR, DENOMINATOR = 4, 85, 100
#: Groups of a point. Counts are kept in 16 bits; one of ``MOST`` may stand for more.
GROUPS, MOST, UNBOUNDED = 64, 65535, 1 << 48
LEAF, FAN = 64, 8
#: Orders in which blocks take neighbours; which one a block takes follows from its shingle.
ORDERS = 8
#: Rows of one part of a block. Larger blocks are compared part by part.
PART_ROWS = 8192
#: Codes that a task packs at a time, codes of a bucket on average at most, and buckets at least.
FLUSH_CODES, BUCKET_CODES, LEAST_BUCKETS = 1 << 21, 1 << 22, 16
#: A shingle in so many sets of one packing is the commonest sort; its sets are not sent where it is counted.
COMMON, ENDLESS = 64, (1 << 31) - 1
_MARK = 65535


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle codes of each text: empty without words, one code for fewer words than a shingle has."""
    codes, bounds = codes_of([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    every = grams(codes, words)
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        if hi - lo >= words:
            out.append(np.unique(every[lo : hi - words + 1]))
        else:
            out.append(grams(codes[lo:hi], int(hi - lo), salt=1 << 32) if hi > lo else np.empty(0, dtype=np.uint64))
    return out


def missing(n):
    """How many shingles of a set of ``n`` a linked one can lack."""
    return n - -(-NUMERATOR * n // DENOMINATOR)


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit digest of the set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def halved(shingles: np.ndarray) -> np.ndarray:
    return shingles[: np.searchsorted(shingles, np.uint64(1 << 63))]


def point_of(shared: np.ndarray) -> np.ndarray:
    """Counts by group, ``MOST`` at most."""
    return np.bincount((mix(shared) & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).clip(max=MOST).astype(np.uint16)


def most_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the common shingles from counts by group; without limit where a group is at ``MOST`` in both."""
    least = np.minimum(a, b)
    overlap = least.sum(axis=-1, dtype=np.int64)
    return np.where((least == MOST).any(axis=-1), UNBOUNDED, overlap) if least.size and least.max() == MOST else overlap


def may_link(overlap, a, b):
    """Whether sets of sizes a and b with at most ``overlap`` common shingles can be within the threshold."""
    return (NUMERATOR + DENOMINATOR) * overlap >= NUMERATOR * (a + b)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield part, shingle_sets(part.column("text").to_pylist())


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, half, rep) of each row; ``half`` counts the codes of the lower half, ``rep`` is the set's class, null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _slices(batches):
            rep = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
            n, half = (pa.array([len(f(s)) for s in sets], pa.int64()) for f in (lambda s: s, halved))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, half, rep], ["doc_id", "n_shingles", "half", "rep"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, half bigint, rep bigint")


def _runs(sorted_codes: np.ndarray) -> np.ndarray:
    """Where each run of equal codes starts."""
    return np.flatnonzero(np.concatenate(([True], sorted_codes[1:] != sorted_codes[:-1]))) if len(sorted_codes) else np.empty(0, dtype=np.int64)


def packed(docs: DataFrame, buckets: int, whole: bool) -> DataFrame:
    """Shingle codes of the classes of rows (doc_id, text, ...), many to a row, by bucket of the code.

    A row holds codes, for each the place of its set in ``reps``, and sizes of those sets. ``whole`` takes all codes, else
    32 bits of those of the lower half. A code that ``COMMON`` sets of one packing have (two, if not ``whole``) is sent
    once, marked; those sets get it in rows of a bucket below 0. With a column ``wanted`` only rows of that class count.
    """
    schema = "bucket int, codes binary, places binary, reps binary, sizes binary"

    def rows_of(sets: list[np.ndarray], reps: list[int], sizes: list[int]) -> pa.RecordBatch:
        ids, ns = np.array(reps, dtype=np.int64), np.array(sizes, dtype=np.int64)
        codes, who = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(codes)
        codes, who = codes[order], who[order]
        starts = _runs(codes)
        long = np.diff(np.concatenate((starts, [len(codes)])))
        shared = np.repeat(long >= (COMMON if whole else 2), long)
        sent = ~shared
        sent[starts] = True
        bucket = ((codes[sent] >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, found, owner = bucket[order], codes[sent][order], np.where(shared, -1, who)[sent][order]
        bounds = [*_runs(bucket), len(bucket)]
        parts = [(int(bucket[lo]), found[lo:hi], owner[lo:hi]) for lo, hi in zip(bounds, bounds[1:])]
        if shared.any():
            parts.append((-1 - reps[0] % buckets, codes[shared] if whole else codes[:0], who[shared]))
        out = []
        for key, c, w in parts:
            own, place = np.unique(w[w >= 0], return_inverse=True)
            places = np.full(len(w), _MARK, dtype=np.uint16)
            places[w >= 0] = place
            out.append((key, c.astype(np.uint64 if whole else np.uint32).tobytes(), places.tobytes(), ids[own].tobytes(), ns[own].tobytes() if whole else b""))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in range(1, 5))], ["bucket", "codes", "places", "reps", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reps, sizes, seen, total = [], [], [], set(), 0
        for part, sets in _slices(batches):
            wanted = part.column("wanted").to_pylist() if "wanted" in part.schema.names else [None] * len(sets)
            for s, w in zip(sets, wanted):
                rep = class_of(s) if len(s) else None
                if rep is None or rep in seen or (w is not None and rep != w):
                    continue
                seen.add(rep)
                held.append(s if whole else halved(s))
                reps.append(rep)
                sizes.append(len(s))
                total += len(held[-1])
                if total >= FLUSH_CODES or len(held) == _MARK:
                    yield rows_of(held, reps, sizes)
                    held, reps, sizes, seen, total = [], [], [], set(), 0
        if total:
            yield rows_of(held, reps, sizes)

    return docs.mapInArrow(run, schema)


def _entries(rows: list[dict], dtype: type) -> tuple[np.ndarray, ...]:
    """Codes, classes, sizes and marks of the entries of packed rows."""
    codes, reps, sizes, marks = [], [], [], []
    for r in rows:
        place, own, n = np.frombuffer(r["places"], dtype=np.uint16), np.frombuffer(r["reps"], dtype=np.int64), np.frombuffer(r["sizes"], dtype=np.int64)
        mark = place == _MARK
        at = np.where(mark, 0, place)
        codes.append(np.frombuffer(r["codes"], dtype=dtype))
        reps.append(own[at] if len(own) else np.zeros(len(at), dtype=np.int64))
        sizes.append(n[at] if len(n) else np.zeros(len(at), dtype=np.int64))
        marks.append(mark)
    return tuple(np.concatenate(x) for x in (codes, reps, sizes, marks))


def by_bucket(rows: DataFrame, make: Callable[[list[dict]], pa.RecordBatch], direct: Callable[[dict], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``make`` to the packed rows of each bucket, which has a bounded number of codes, and ``direct`` to each row of a bucket below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    yield direct(row)
                    continue
                if held and held[0]["bucket"] != row["bucket"]:
                    yield make(held)
                    held = []
                held.append(row)
        if held:
            yield make(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def shared_counts(rows: DataFrame) -> DataFrame:
    """(rep, n): how many packed codes (of 32 bits within a bucket) of each class some other class may have as well."""

    def counted(reps: np.ndarray) -> pa.RecordBatch:
        rep, n = np.unique(reps, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n.astype(np.int64))], ["rep", "n"])

    def of_bucket(held: list[dict]) -> pa.RecordBatch:
        codes, reps, _, marks = _entries(held, np.uint32)
        order = np.argsort(codes)
        codes, reps, marks = codes[order], reps[order], marks[order]
        starts = _runs(codes)
        alone = (np.minimum.reduceat(reps, starts) == np.maximum.reduceat(reps, starts)) & ~np.logical_or.reduceat(marks, starts)
        return counted(reps[~np.repeat(alone, np.diff(np.concatenate((starts, [len(codes)])))) & ~marks])

    found = by_bucket(rows, of_bucket, lambda row: counted(_entries([row], np.uint32)[1]), "rep bigint, n bigint")
    return found.groupBy("rep").agg(F.sum("n").alias("n"))


def ordered_sets(rows: DataFrame) -> DataFrame:
    """(rep, n, first, codes): the codes of each class that another packed one has, rare ones first; ``first`` of them are its prefix.

    Classes that have no shared code in their prefix link with nothing and are left out.
    """

    def by_class(codes: np.ndarray, reps: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(reps, kind="stable")
        codes, reps, sizes, counts = codes[order], reps[order], sizes[order], counts[order].astype(np.int32)
        starts = _runs(reps)
        cuts = list(zip(starts, [*starts[1:], len(reps)]))
        blobs = [pa.array([x[lo:hi].tobytes() for lo, hi in cuts], pa.binary()) for x in (codes, counts)]
        return pa.RecordBatch.from_arrays([pa.array(reps[starts]), pa.array(sizes[starts]), *blobs], ["rep", "n", "codes", "counts"])

    def of_bucket(held: list[dict]) -> pa.RecordBatch:
        codes, reps, sizes, marks = _entries(held, np.uint64)
        order = np.lexsort((reps, codes))
        codes, reps, sizes, marks = codes[order], reps[order], sizes[order], marks[order]
        again = np.concatenate(([False], (codes[1:] == codes[:-1]) & (reps[1:] == reps[:-1]) & ~marks[1:] & ~marks[:-1]))
        codes, reps, sizes, marks = codes[~again], reps[~again], sizes[~again], marks[~again]
        starts = _runs(codes)
        long = np.diff(np.concatenate((starts, [len(codes)])))
        counts = np.repeat(np.where(np.logical_or.reduceat(marks, starts), ENDLESS, long), long)
        keep = (counts > 1) & ~marks
        return by_class(codes[keep], reps[keep], sizes[keep], counts[keep])

    def direct(row: dict) -> pa.RecordBatch:
        codes, reps, sizes, _ = _entries([row], np.uint64)
        return by_class(codes, reps, sizes, np.full(len(codes), ENDLESS))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                codes = np.concatenate([np.frombuffer(p["codes"], dtype=np.uint64) for p in row["parts"]])
                counts = np.concatenate([np.frombuffer(p["counts"], dtype=np.int32) for p in row["parts"]])
                # Of a class that several packings have, codes of the commonest sort may come from each of them.
                codes, at = np.unique(codes, return_index=True)
                codes = codes[np.lexsort((codes, counts[at]))]
                first = min(missing(row["n"]) + 1 - (row["n"] - len(codes)), len(codes))
                if first > 0:
                    out.append((row["rep"], row["n"], first, codes.tobytes()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["rep", "n", "first", "codes"])

    found = by_bucket(rows, of_bucket, direct, "rep bigint, n bigint, codes binary, counts binary")
    # The parts of one class are no larger than its text.
    parts = found.groupBy("rep").agg(F.max("n").alias("n"), F.collect_list(F.struct("codes", "counts")).alias("parts"))
    return parts.mapInArrow(assemble, "rep bigint, n bigint, first bigint, codes binary")


def prefixes(sets: DataFrame) -> DataFrame:
    """(h, n, rep, left, point): each prefix code of each class; ``left`` counts its codes from that one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                first = part.column("first").to_numpy()
                codes = [np.frombuffer(c, dtype=np.uint64) for c in part.column("codes").to_pylist()]
                points = [point_of(c).tobytes() for c in codes]
                columns = [
                    pa.array(np.concatenate([c[:k] for c, k in zip(codes, first)]).view(np.int64)),
                    pa.array(np.repeat(part.column("n").to_numpy(), first)),
                    pa.array(np.repeat(part.column("rep").to_numpy(), first)),
                    pa.array(np.concatenate([len(c) - np.arange(k, dtype=np.int64) for c, k in zip(codes, first)])),
                    pa.array([p for p, k in zip(points, first) for _ in range(k)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["h", "n", "rep", "left", "point"])

    return sets.mapInArrow(run, "h bigint, n bigint, rep bigint, left bigint, point binary")


def neighbours(n: np.ndarray, left: np.ndarray, points: np.ndarray, comp: np.ndarray, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the bounds let pass, of rows next to each other by size and counts, or by counts from another group on, and of each row with the most ordinary one."""
    order = np.lexsort((*np.roll(points, turn * GROUPS // ORDERS, axis=1).T[::-1], n)[: None if turn == 0 else GROUPS])
    hub = int(np.argmax(left / n))
    a, b = np.concatenate((order[:-1], np.full(len(n), hub))), np.concatenate((order[1:], np.arange(len(n))))
    overlap = np.minimum(most_common(points[a], points[b]), np.minimum(left[a], left[b]))
    good = may_link(overlap, n[a], n[b]) & (comp[a] != comp[b])
    return a[good], b[good]


def tree_pairs(n: np.ndarray, left: np.ndarray, points: np.ndarray, comp: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that the bounds let pass and that are in different components, by an R-tree joined with itself.

    With ``side`` only pairs of rows on different sides count. A node holds the range of sizes and the largest
    count of each group below it; two nodes are opened only if those could belong to a link.
    """
    order = np.lexsort((points[:, 0], left, n))
    starts = np.arange(0, len(n), LEAF)
    levels = [(np.minimum.reduceat(n[order], starts), np.maximum.reduceat(left[order], starts), np.maximum.reduceat(points[order], starts, axis=0))]
    while len(levels[-1][0]) > 1:
        low, high, top = levels[-1]
        starts = np.arange(0, len(low), FAN)
        levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(top, starts, axis=0)))
    found, stack = [], [(len(levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        low, high, top = levels[level]
        if not may_link(min(int(most_common(top[i], top[j])), int(high[i]), int(high[j])), int(low[i]), int(low[j])):
            continue
        if level:
            below = len(levels[level - 1][0])
            for x in range(i * FAN, min(below, (i + 1) * FAN)):
                stack += [(level - 1, x, y) for y in range(max(x, j * FAN) if i == j else j * FAN, min(below, (j + 1) * FAN))]
            continue
        a, b = order[i * LEAF : (i + 1) * LEAF], order[j * LEAF : (j + 1) * LEAF]
        differ = comp[a][:, None] != comp[b][None, :]
        if i == j:
            differ &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        if side is not None:
            differ &= side[a][:, None] != side[b][None, :]
        x, y = np.nonzero(differ & may_link(np.minimum(left[a][:, None], left[b][None, :]), n[a][:, None], n[b][None, :]))
        a, b = a[x], b[y]
        if len(a):
            good = may_link(most_common(points[a], points[b]), n[a], n[b])
            found.append((a[good], b[good]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def block_pairs(rows: DataFrame, every: bool) -> DataFrame:
    """(a, b), a < b, that share a block (h, i, j) and pass the bounds; ``every`` pair, or neighbours only."""
    columns = ["h", "i", "j", "n", "rep", "left", "point", "comp", "part"]

    def emit(part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, i, j, n, rep, left, point, comp, side = part
        points = np.frombuffer(b"".join(point), dtype=np.uint16).reshape(len(point), GROUPS)
        change = np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        out = []
        for lo, hi in zip(np.concatenate(([0], change)), np.concatenate((change, [len(h)]))):
            if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                continue
            if every:
                x, y = tree_pairs(n[lo:hi], left[lo:hi], points[lo:hi], comp[lo:hi], side[lo:hi] if i[lo] != j[lo] else None)
            else:
                x, y = neighbours(n[lo:hi], left[lo:hi], points[lo:hi], comp[lo:hi], int(h[lo]) % ORDERS)
            if len(x):
                ids = rep[lo:hi]
                out.append(np.stack((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]))))
        if not out:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        return pairs[0], pairs[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in ended(batches):
            if batch is not None:
                now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
                held = now if held is None else [np.concatenate(p) for p in zip(held, now)]
                h, i, j = held[:3]
                last = np.flatnonzero((h != h[-1]) | (i != i[-1]) | (j != j[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
            elif held is not None:
                cut = len(held[0])
            else:
                return
            if cut:
                a, b = emit([c[:cut] for c in held])
                held = [c[cut:] for c in held]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = rows.select(*columns).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "rep")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) within the threshold, by their whole sets; what no other set has cannot be common."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "codes_a", "codes_b"))):
                both = len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
                keep.append(DENOMINATOR * both >= NUMERATOR * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def of(side: str) -> DataFrame:
        return sets.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("codes").alias(f"codes_{side}"))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(exact, "a bigint, b bigint")


def placed(rows: DataFrame, comp: DataFrame | None, part_rows: int) -> DataFrame:
    """Prefix rows with comp, part and the cells (i, j) of their block in which they are compared.

    A block of more than ``part_rows`` rows has parts, which neighbours are taken within. For all pairs parts meet
    two by two; a component with more rows than a part has parts of its own, and those don't meet each other.
    """
    if comp is None:
        rows = rows.withColumn("comp", F.col("rep"))
    else:
        rows = rows.join(comp.select(F.col("id").alias("rep"), F.col("component").alias("found")), "rep", "left")
        rows = rows.withColumn("comp", F.coalesce("found", "rep")).drop("found")
    # At most one block in ``part_rows`` rows is heavy.
    heavy = scratch.materialize(rows.groupBy("h").agg(F.count("*").alias("many")).where(F.col("many") > part_rows), "heavy")
    few = F.broadcast if heavy.count() <= BROADCAST_ROWS else lambda x: x
    heavy = few(heavy)
    salt = lambda n: F.pmod(F.xxhash64("rep"), F.ceil(n / part_rows))
    if comp is None:
        cut = rows.join(heavy, "h", "left").withColumn("part", F.coalesce(salt(F.col("many")), F.lit(0)))
        return cut.drop("many").withColumns({"i": F.col("part"), "j": F.col("part")})
    sizes = rows.join(heavy, "h").groupBy("h", "comp").agg(F.count("*").alias("n"))
    own = sizes.where(F.col("n") > part_rows).select("h", "comp", "n", F.ceil(F.col("n") / part_rows).alias("parts"))
    rest = sizes.where(F.col("n") <= part_rows).groupBy("h").agg(F.sum("n").alias("n")).select("h", F.lit(None).cast("long").alias("comp"), "n", F.ceil(F.col("n") / part_rows).alias("parts"))
    # A few rows to a heavy block: its large components, and one for all others.
    blocks = own.unionAll(rest).groupBy("h").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("comp", F.lit(-1)).alias("comp"), F.col("comp").isNull().alias("mixed"), "parts"))).alias("ranges"))

    def placing(x: DataFrame) -> DataFrame:
        is_own = lambda r: ~r["mixed"] & (r["comp"] == F.col("comp"))
        mine = F.coalesce(F.get(F.filter("ranges", is_own), F.lit(0)), F.get(F.filter("ranges", lambda r: r["mixed"]), F.lit(0)))
        x = x.withColumn("mine", mine)
        before = F.aggregate(F.slice("ranges", F.lit(1), F.array_position("ranges", F.col("mine")).cast("int") - 1), F.lit(0).cast("long"), lambda a, r: a + r["parts"])
        x = x.withColumns({"before": before, "last": F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["parts"]) - 1})
        x = x.withColumn("part", F.col("before") + F.pmod(F.xxhash64("rep"), F.col("mine.parts")))
        foreign = lambda p: F.col("mine.mixed") | (p < F.col("before")) | (p >= F.col("before") + F.col("mine.parts"))
        return x.withColumn("meet", F.filter(F.sequence(F.lit(0).cast("long"), F.col("last")), foreign))

    cut = placing(rows.join(few(blocks), "h", "left"))
    cut = cut.withColumns({"part": F.coalesce("part", F.lit(0)), "meet": F.when(F.col("ranges").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.col("meet"))})
    pair = F.transform("meet", lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")))
    return cut.select("h", "n", "rep", "left", "point", "comp", "part", F.explode(pair).alias("p")).select("*", "p.i", "p.j").drop("p")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    Null and blank texts have no shingles and link with nothing; a null id keeps its row and has a null component.
    Equal sets are one point, whatever their number. Rows that share an id are one document: its links are those of all
    its rows, while n_shingles is the row's own. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = scratch.materialize(sketches(docs), "sketches")
    known = sketch.where(F.col("rep").isNotNull() & F.col("doc_id").isNotNull())
    classes = scratch.materialize(known.groupBy("rep").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.max("half").alias("half")), "classes")
    totals = classes.agg(F.sum("half")).first()[0] or 0
    buckets = lambda codes: int(max(LEAST_BUCKETS, -(-codes // BUCKET_CODES)))
    shared = shared_counts(packed(docs.where(F.col("doc_id").isNotNull()), buckets(totals), whole=False))
    lacking = F.col("n") - F.ceil(F.lit(NUMERATOR) * F.col("n") / DENOMINATOR)
    some = classes.join(shared.withColumnRenamed("n", "shared"), "rep", "left").where(F.col("half") - F.coalesce("shared", F.lit(0)) <= lacking)
    some = scratch.materialize(some.select(F.col("least").alias("doc_id"), F.col("rep").alias("wanted"), "n"), "wanted")
    size = some.agg(F.count("*"), F.sum("n")).first()
    wanted = some.select("doc_id", "wanted")
    texts = docs.join(F.broadcast(wanted) if size[0] <= BROADCAST_ROWS else wanted, "doc_id").select("doc_id", "text", "wanted")
    sets = scratch.materialize(ordered_sets(packed(texts, buckets(size[1] or 0), whole=True)), "sets")
    prefix = scratch.materialize(prefixes(sets), "prefixes")

    first = scratch.materialize(block_pairs(placed(prefix, None, PART_ROWS), every=False), "pairs-1")
    # Rows of one id are one document.
    ids = known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where(F.col("a") != F.col("z"))
    same = known.select("doc_id", F.col("rep").alias("b")).join(ids.select("doc_id", "a"), "doc_id").where(F.col("a") != F.col("b")).select("a", "b")
    links = scratch.materialize(verified(first, sets).unionAll(same), "links-1")
    rest = block_pairs(placed(prefix, components(links), PART_ROWS), every=True)
    rest = scratch.materialize(rest.join(first, ["a", "b"], "left_anti"), "pairs-2")
    comp = components(links.unionAll(verified(rest, sets)))
    lows = comp.join(classes, F.col("id") == F.col("rep")).groupBy("component").agg(F.min("least").alias("low"))
    placed_classes = comp.join(lows, "component").select(F.col("id").alias("rep"), "low")
    by_class = classes.join(placed_classes, "rep", "left").select("rep", F.coalesce("low", "least").alias("found"))
    return sketch.join(by_class, "rep", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id")
    )
