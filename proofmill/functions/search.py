"""What a batch of lower-case texts holds, by numpy over many texts at a time: words of a list, and phrases that come often."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are searched together, unless one text is longer; memory then grows with neither rows nor their length.
SLICE_BYTES = 1 << 20
#: The first 0 to 4 bytes of four.
_FIRST = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
#: Odd factors by which the parts of a word, and the words of a phrase, enter its number.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_WORD = re.compile(rb"[a-z]{3,}")


def _sieve_place(first: np.ndarray) -> np.ndarray:
    """Where three bytes fall among 65536."""
    return ((first & _FIRST[3]) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def sieve(words: set[str]) -> np.ndarray:
    """Which of 65536 places the first three bytes of some word fall on."""
    out = np.zeros(1 << 16, bool)
    out[_sieve_place(np.array([int.from_bytes(w.encode()[:3], "little") for w in words if len(w.encode()) >= 3], np.uint32))] = True
    return out


class Texts:
    """Some texts as one string of bytes, parted by zeros, with the four bytes that begin at every place, and the places where a word may begin."""

    def __init__(self, texts: list[bytes], passed: np.ndarray) -> None:
        self.texts = texts
        joined = b"\0".join([b"", *texts, b"\0\0\0\0\0\0\0\0"])
        self.starts = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.bytes = np.frombuffer(joined, np.uint8)
        self.four = np.ndarray(len(joined) - 3, "<u4", joined, strides=(1,)).copy()
        self.places = np.flatnonzero(passed[_sieve_place(self.four)])
        self.at_places = self.four[self.places]
        self._held: dict[str, np.ndarray] = {}

    def rows(self, places: np.ndarray) -> np.ndarray:
        """The numbers of the texts that have these places."""
        return np.searchsorted(self.starts, places, "right") - 1

    def holding(self, word: str) -> np.ndarray:
        """Which texts hold a word, by its first and last four bytes: of longer words than eight bytes perhaps too many."""
        if word not in self._held:
            w = word.encode()
            key, mask = np.uint32(int.from_bytes(w[:4], "little")), _FIRST[min(len(w), 4)]
            at = np.flatnonzero(self.four & mask == key) if len(w) < 3 else self.places[self.at_places & mask == key]
            if len(w) > 4:
                at = at[self.four[np.minimum(at + len(w) - 4, len(self.four) - 1)] == np.uint32(int.from_bytes(w[-4:], "little"))]
            self._held[word] = np.bincount(self.rows(at), minlength=len(self.texts)) > 0
        return self._held[word]

    def holding_some(self, words: tuple) -> np.ndarray:
        """Which texts hold one of the words; every one of a tuple within is needed."""
        found = np.zeros(len(self.texts), bool)
        for every in ((w,) if isinstance(w, str) else w for w in words):
            both = np.ones(len(self.texts), bool)
            for w in sorted(every, key=len, reverse=True):
                both = both & self.holding(w) if both.any() else both
            found |= both
        return found

    def odd(self) -> np.ndarray:
        """Which texts hold a soft hyphen or a character beyond U+00FF."""
        at = np.flatnonzero(self.bytes >= 0xC2)
        lead = self.bytes[at]
        at = at[(lead >= 0xC4) | ((lead == 0xC2) & (self.bytes[at + 1] == 0xAD))]
        return np.bincount(self.rows(at), minlength=len(self.texts)) > 0

    def phrased(self, most: int) -> np.ndarray:
        """Numbers of the texts with a three-word phrase more than ``most`` times; a few more where numbers of phrases are equal by chance."""
        letters = (self.bytes - np.uint8(97)) < 26
        edges = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        start, size = edges[::2], edges[1::2] - edges[::2]
        start, size = start[size >= 3], size[size >= 3]
        head = self.four[start] & _FIRST[np.minimum(size, 4)]
        middle = self.four[start + 4 * (size > 4)] & _FIRST[np.clip(size - 4, 0, 4)]
        tail = self.four[start + np.maximum(size - 4, 0)] & _FIRST[np.where(size > 8, 4, 0)]
        parts = zip((head, middle, tail, size), _FACTORS, strict=True)
        words = np.bitwise_xor.reduce([part.astype(np.uint64) * by for part, by in parts])
        words ^= words >> np.uint64(29)
        row = self.rows(start)
        inside = row[2:] == row[:-2]
        row = row[2:][inside]
        phrases = (words[:-2] * _FACTORS[0] + words[1:-1] * _FACTORS[1] + words[2:] * _FACTORS[2])[inside] + row.astype(np.uint64) * _FACTORS[3]
        ordered = np.sort(phrases)
        often = np.unique(ordered[most:][ordered[most:] == ordered[: len(ordered) - most]]) if len(ordered) > most else ordered[:0]
        return np.unique(row[often[np.minimum(np.searchsorted(often, phrases), len(often) - 1)] == phrases]) if len(often) else row[:0]


def most_frequent(text: bytes) -> tuple[str, int]:
    """The most frequent three-word phrase of a text that has one, of equals the first, and how often it comes. Words are a-z, three letters or more."""
    words = _WORD.findall(text)
    phrase, n = max(Counter(zip(words, words[1:], words[2:])).items(), key=lambda x: x[1])
    return b" ".join(phrase).decode(), n


def looked_up(texts: pa.Array, groups: tuple[tuple, ...], most: int, needed: dict[int, bytes] | None = None) -> pa.Array:
    """Of each text ``groups``, a number whose bit of a group is set where the text may hold one of its words, and ``phrase`` and ``times`` of a phrase more than ``most`` times, else null.

    A group in ``needed`` has its bit only where that pattern is found as well; it is tried on texts with the words. The bit after
    those of all groups is set where a text has a soft hyphen or a character beyond U+00FF.
    """
    flags, phrases, times = np.zeros(len(texts), np.int64), [None] * len(texts), [None] * len(texts)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1).tolist(), len(texts)]
    passed = sieve({w for words in groups for every in words for w in ((every,) if isinstance(every, str) else every)})
    patterns = {bit: re.compile(p) for bit, p in (needed or {}).items()}
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            part = Texts([t or b"" for t in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()], passed)
            for bit, words in enumerate(groups):
                held = part.holding_some(words)
                if bit in patterns:
                    for row in np.flatnonzero(held).tolist():
                        held[row] = patterns[bit].search(part.texts[row]) is not None
                flags[lo:hi] |= held.astype(np.int64) << bit
            flags[lo:hi] |= part.odd().astype(np.int64) << len(groups)
            for row in part.phrased(most).tolist():
                phrase, n = most_frequent(part.texts[row])
                if n > most:
                    phrases[lo + row], times[lo + row] = phrase, n
    return pa.StructArray.from_arrays([pa.array(flags), pa.array(phrases, pa.string()), pa.array(times, pa.int32())], ["groups", "phrase", "times"])
