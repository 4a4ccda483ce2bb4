"""Alignment of two tokenizers' tokens by a dictionary of groups.

Byte offsets at which a token of either tokenizer ends cut a text into groups: the ids of A and of B over the same bytes.
A group is interned as the text ``a1,a2|b1``. Tasks encode slices of documents and write a pack for each: its distinct
groups once, its documents as numbers of them with frequencies, and in how many of its documents each id pair is linked.
Spark sums the pairs over the packs, expands each distinct group of the corpus into its links once, joins the pairs to
them, and joins what a group is worth back to the packs by the group's text; a pack then adds up its documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm import scratch
from proofmill.llm.words import mix

#: Bytes of the texts of a pack, unless one text is longer; characters that one call of a tokenizer gets.
PACK_BYTES, CHUNK_CHARS = 1 << 21, 100_000
#: A tokenizer file over this size is not broadcast but refused.
MAX_TOKENIZER_BYTES = 64 << 20
_PACK = (
    "pack bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, "
    "distinct array<int>, ref array<int>, times array<int>, groups array<string>, pair_a array<int>, pair_b array<int>, pair_docs array<int>"
)
_DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOADED: dict[str, tuple] = {}


def _byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: How byte-level pre-tokenizers cut a text, and characters whose classes are the same in every version of Unicode's tables.
_CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile("[\x00-\u024f]*")


def quick_encoder(data: bytes, a_bytes: list[bytes]) -> Callable[[str], list[int]] | None:
    """A faster encoder of a byte-level vocabulary whose merges stand in the order of their ids, else None.

    It merges the pair of the lowest id first, which then is the same as the first in the list of merges.
    """
    model = json.loads(data)
    cut = model.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"].get("merges", [])]
    vocabulary, special = model["model"]["vocab"], {t["content"] for t in model.get("added_tokens", [])}
    ids = [vocabulary.get("".join(m)) for m in merges]
    byte_level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if model["model"].get("type") != "BPE" or not byte_level or model.get("normalizer") or None in ids or any(a >= b for a, b in zip(ids, ids[1:])):
        return None
    import tiktoken

    ranks = {a_bytes[i]: i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def load(a_data: bytes, b_data: bytes) -> tuple:
    """Two functions from texts to id lists, and the bytes of each id, of A (byte-level, .json) and B (pieces, .model)."""
    key = hashlib.sha256(a_data + b_data).hexdigest()
    if key not in _LOADED:
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_str(a_data.decode()), sentencepiece.SentencePieceProcessor(model_proto=b_data)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        byte_of = _byte_of()
        a_bytes = [b""] * (max(a.get_vocab().values()) + 1)
        for token, i in a.get_vocab().items():
            a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        b_bytes = [bytes((int(p[3:5], 16),)) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        quick = quick_encoder(a_data, a_bytes)
        slow = lambda text: a.encode(text, add_special_tokens=False).ids
        encode_a = lambda texts: [quick(" " + t) if quick and _PLAIN.fullmatch(t) else slow(" " + t) for t in texts]
        encode_b = lambda texts: b.encode(texts, num_threads=1)
        _LOADED[key] = encode_a, encode_b, a_bytes, b_bytes
    return _LOADED[key]


@dataclass
class Groups:
    """Groups of a slice: where each begins in the ids of A and of B (one bound more than groups), and the groups' bounds of each text."""

    a: np.ndarray
    b: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    bounds: np.ndarray


def encoded(tools: tuple, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of A and of B of each text; none where the text is null or empty or a tokenizer's bytes differ from a blank and the text."""
    encode_a, encode_b, a_bytes, b_bytes = tools
    none = np.empty(0, dtype=np.int64)
    a, b = [none] * len(texts), [none] * len(texts)
    held: list[int] = []

    def flush() -> None:
        some = [texts[i] for i in held]
        for i, x, y in zip(held, encode_a(some), encode_b(some)):
            whole = b" " + texts[i].encode()
            if b"".join(map(a_bytes.__getitem__, x)) == whole == b"".join(map(b_bytes.__getitem__, y)):
                a[i], b[i] = np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)
        held.clear()

    chars = 0
    for i, text in enumerate(texts):
        if text:
            if held and chars + len(text) > CHUNK_CHARS:
                flush()
                chars = 0
            held.append(i)
            chars += len(text)
    if held:
        flush()
    return a, b


def grouped(a: list[np.ndarray], b: list[np.ndarray], a_lengths: np.ndarray, b_lengths: np.ndarray) -> Groups:
    """Cut ids where the bytes of tokens of both end."""
    every_a, every_b = np.concatenate(a or [np.empty(0, np.int64)]), np.concatenate(b or [np.empty(0, np.int64)])
    a_ends, b_ends = np.cumsum(a_lengths[every_a]), np.cumsum(b_lengths[every_b])
    ends_a, ends_b = (np.zeros(int(e[-1]) + 1 if len(e) else 1, dtype=bool) for e in (a_ends, b_ends))
    ends_a[a_ends], ends_b[b_ends] = True, True
    a_starts = np.concatenate(([0], np.flatnonzero(ends_b[a_ends]) + 1))
    b_starts = np.concatenate(([0], np.flatnonzero(ends_a[b_ends]) + 1))
    tokens = np.cumsum([0, *map(len, a)])
    return Groups(every_a, every_b, a_starts, b_starts, np.searchsorted(a_starts, tokens))


def _digests(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number of each run of ids: a polynomial modulo 2^64 of its ids and its length."""
    power = np.full(len(ids) + 1, _BASE)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(len(ids) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * power[:-1])))
    lo, hi = starts[:-1], starts[1:]
    return mix((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def _spread(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the runs ``of`` (with bounds ``starts``) each member's place, and which of ``of`` it belongs to."""
    sizes = starts[of + 1] - starts[of]
    owner = np.repeat(np.arange(len(of)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of][owner], owner


def interned(g: Groups) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct group, and the number of each group's; digests find equal groups and their ids are compared."""
    key = mix(_digests(g.a, g.a_starts)) + _digests(g.b, g.b_starts)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    for ids, starts in ((g.a, g.a_starts), (g.b, g.b_starts)):
        like = first[number]
        same = np.array_equal(np.diff(starts), (starts[1:] - starts[:-1])[like])
        if not same or not np.array_equal(ids, ids[_spread(starts, like)[0]]):
            raise ValueError("two groups share a digest")
    return first, number


def pair_documents(g: Groups, first: np.ndarray, owners: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a << 32 | b), and in how many documents each is linked, given the distinct groups ``refs`` of each document."""
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    (at_a, of_a), (at_b, of_b) = _spread(g.a_starts, first), _spread(g.b_starts, first)
    once = lambda ids, at, of: np.unique(of << 32 | ids[at])
    left, right = once(g.a, at_a, of_a), once(g.b, at_b, of_b)
    low = (1 << 32) - 1
    per_b = np.bincount(right >> 32, minlength=len(first))
    begin_b = np.concatenate(([0], np.cumsum(per_b)))
    place, owner = _spread(begin_b, left >> 32)
    pairs, number = np.unique((left[owner] & low) << 32 | (right[place] & low), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(left[owner] >> 32, minlength=len(first)))))
    at, of = _spread(bounds, refs)
    linked = np.unique(owners[of] * len(pairs) + number[at])
    return pairs, np.bincount(linked % len(pairs), minlength=len(pairs))


def packed(tools: tuple, pack: int, doc_ids: list, texts: list[str | None], lengths: tuple[np.ndarray, np.ndarray]) -> dict[str, list]:
    """A pack's row: see ``_PACK``. ``distinct`` is how many of ``ref`` and ``times`` each document has."""
    a, b = encoded(tools, texts)
    g = grouped(a, b, *lengths)
    first, number = interned(g)
    sizes = np.diff(g.a_starts) * np.diff(g.b_starts)
    total = np.concatenate(([0], np.cumsum(sizes)))
    names = ["|".join(",".join(map(str, ids[starts[i] : starts[i + 1]].tolist())) for ids, starts in ((g.a, g.a_starts), (g.b, g.b_starts))) for i in first.tolist()]
    named = np.array(names, dtype=object)[number] if names else np.empty(0, dtype=object)
    whole = [";".join(named[lo:hi].tolist()) for lo, hi in zip(g.bounds[:-1].tolist(), g.bounds[1:].tolist())]
    many = max(len(names), 1)
    occurring = np.repeat(np.arange(len(texts)), np.diff(g.bounds))
    found, times = np.unique(occurring * many + number, return_counts=True)
    owners, refs = found // many, found % many
    pairs, documents = pair_documents(g, first, owners, refs)
    return {
        "pack": [pack], "doc_id": [doc_ids], "n_a": [[len(x) for x in a]], "n_b": [[len(x) for x in b]], "n_groups": [np.diff(g.bounds).tolist()],
        "n_links": [(total[g.bounds[1:]] - total[g.bounds[:-1]]).tolist()], "sha": [[hashlib.sha256(x.encode()).hexdigest() if x else "" for x in whole]],
        "distinct": [np.bincount(owners, minlength=len(texts))], "ref": [refs], "times": [times], "groups": [names],
        "pair_a": [pairs >> 32], "pair_b": [pairs & (1 << 32) - 1], "pair_docs": [documents],
    }


def packs_of(docs: DataFrame, a_data: bytes, b_data: bytes) -> DataFrame:
    """The packs of rows (row, doc_id, text); a pack is named by its first row."""
    for data in (a_data, b_data):
        if len(data) > MAX_TOKENIZER_BYTES:
            raise ValueError(f"the tokenizer has {len(data)} bytes, over {MAX_TOKENIZER_BYTES}")
    shared = docs.sparkSession.sparkContext.broadcast((a_data, b_data))
    item = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in _PACK.split(", ")]
    schema = pa.schema([(name, pa.list_(item[kind[6:-1]]) if kind.startswith("array") else pa.int64()) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tools = load(*shared.value)
        lengths = tuple(np.array([len(x) for x in tokens], dtype=np.int64) for tokens in tools[2:])
        for batch in batches:
            sizes = np.array(pc.fill_null(pc.binary_length(batch.column("text")), 0))
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // PACK_BYTES)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    rows, doc_ids, texts = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("row", "doc_id", "text"))
                    yield pa.RecordBatch.from_pydict(packed(tools, rows[0], doc_ids, texts, lengths), schema=schema)

    return docs.select("row", "doc_id", "text").mapInArrow(run, _PACK)


def pair_counts(packs: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents the pair is linked, and whether that is the most of any pair of ``a``."""
    rows = packs.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_docs")).alias("p"))
    counts = rows.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.pair_docs").alias("n"))
    counts = scratch.materialize(counts, "pairs")
    most = counts.groupBy(F.col("a").alias("of")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("a") == F.col("of")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def group_values(packs: DataFrame, counts: DataFrame) -> DataFrame:
    """(group, count_sum, n_best) of each distinct group, whose links are expanded here and nowhere else."""
    groups = packs.select(F.explode("groups").alias("group")).distinct()
    side = lambda i: F.transform(F.split(F.element_at(F.split("group", r"\|"), i), ","), lambda x: x.cast("int"))
    ids = groups.select("group", side(1).alias("as"), side(2).alias("bs"))
    # A token that a group has several times is one row with its number, so a long group is no square of its length.
    numbered = lambda c: F.transform(F.array_distinct(c), lambda x: F.struct(x.alias("id"), F.size(F.filter(c, lambda y: y == x)).alias("n")))
    links = ids.select("group", numbered("as").alias("as"), F.explode(numbered("bs")).alias("y")).select("group", "y", F.explode("as").alias("x"))
    links = links.select("group", F.col("x.id").alias("x"), F.col("y.id").alias("y"), (F.col("x.n").cast("long") * F.col("y.n")).alias("m"))
    joined = links.join(counts, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")))
    return joined.groupBy("group").agg(F.sum(F.col("m") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"))


def added_up(packs: DataFrame, values: DataFrame) -> DataFrame:
    """The documents of the packs, with what their groups are worth by frequency."""
    entries = packs.select("pack", F.posexplode("groups").alias("at", "group")).join(values, "group")
    worth = entries.groupBy(F.col("pack").alias("of")).agg(F.collect_list(F.struct("at", "count_sum", "n_best")).alias("worth"))
    plain = packs.drop("groups", "pair_a", "pair_b", "pair_docs")
    joined = plain.join(worth, F.col("pack") == F.col("of"), "left").drop("of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = lambda c: batch.column(c).slice(i, 1).flatten()  # noqa: B023, E731
                worth = part("worth")
                fields = {k: np.asarray(worth.field(k)) for k in ("at", "count_sum", "n_best")}
                by_number = np.argsort(fields["at"])
                ends = np.concatenate(([0], np.cumsum(np.asarray(part("distinct")))))
                sums = []
                for k in ("n_best", "count_sum"):
                    each = fields[k][by_number][np.asarray(part("ref"))] * np.asarray(part("times")) if len(by_number) else np.empty(0, np.int64)
                    run_up = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
                    sums.append(pa.array(run_up[ends[1:]] - run_up[ends[:-1]], pa.int64()))
                arrays = [*(part(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, part("sha")]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _DOC.split(", ")])

    return joined.mapInArrow(run, _DOC)


def align_tokens(docs: DataFrame, a_data: bytes, b_data: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs`` with doc_id and text.

    A pair's count is the number of rows of ``docs`` that link it: repeated rows count apart, and a row that links it in
    several groups once. Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens:
    zeros and an empty digest. Null ids are kept, other columns are ignored whatever their names, texts are encoded whole,
    and an empty table gives no rows. ``a_data`` is a byte-level .json file, ``b_data`` a .model file.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    packs = scratch.materialize(packs_of(rows, a_data, b_data), "packs")
    return added_up(packs, group_values(packs, pair_counts(packs)))
