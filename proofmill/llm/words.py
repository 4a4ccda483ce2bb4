"""64-bit codes of words, made for many texts at once.

A word is a run of bytes other than space and tab to carriage return. Its code is a polynomial of table values of
its bytes modulo 2^64, mixed; equal words have equal codes and two different words share one with a chance of
about 2^-64. Texts of any length are read in pieces that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(20240307).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 19
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n``; kept for later calls."""
    if not _POWERS or len(_POWERS[0]) < n:
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(max(n, PIECE + 1), np.uint64(base), dtype=np.uint64)
            row[0] = 1
            _POWERS[at : at + 1] = [np.cumprod(row)]
    return _POWERS


def _codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of ``data`` and the places where they start."""
    b = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[b], [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(b))
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[b] * power[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not _SPACE[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def codes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts in turn, and where each text's begin: one more bound than texts."""
    found, counts, held, size = [np.empty(0, dtype=np.uint64)], [], [], 0

    def flush() -> None:
        if held:
            codes, starts = _codes(b"\n".join(held))
            offsets = np.cumsum([0, *(len(t) + 1 for t in held)])
            counts.extend(np.diff(np.searchsorted(starts, offsets)).tolist())
            found.append(codes)
            held.clear()

    for text in texts:
        if size + len(text) > PIECE:
            flush()
            size = 0
        if len(text) > PIECE:
            parts = [_codes(p)[0] for p in _pieces(text)]
            found.extend(parts)
            counts.append(sum(map(len, parts)))
        else:
            held.append(text)
            size += len(text)
    flush()
    return np.concatenate(found), np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64)


def grams(codes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Codes of each ``length`` consecutive words; text bounds are the caller's to keep."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, np.uint64(salt + length), dtype=np.uint64)
    factor = 1
    for k in range(length):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total += codes[k : k + n] * np.uint64(factor)
    return mix(total)


def split_words(text: Column, between: str) -> Column:
    """The words of ``text`` in order, as what lies between matches of ``between``, which must take whole gaps.

    Splitting reads a text once. Extracting matches copies the whole text for each of them.
    """
    return F.array_remove(F.split(text, between, -1), "")
