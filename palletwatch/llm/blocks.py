"""Whole texts as word arrays: numpy helpers that run inside tasks, over bounded slices.

Words are runs of bytes other than space and tab to carriage return; being ASCII,
these separators can be cut on UTF-8 bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# An odd multiplier and its inverse modulo 2**64, for spans of a prefix sum.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

PIECE = 1 << 19  # values hashed at a time

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * PIECE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that order and remainder of a hash are unrelated to its making."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span of the values behind ``sums``, equal for equal spans."""
    return mix((sums[ends] - sums[starts]) * _power(BASE_INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span, for spans in ascending order of both ends; in pieces, of bounded memory."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
        sums = prefix(values[low : int(ends[j - 1])])
        out[i:j] = spans(sums, starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


@dataclass
class Words:
    """The words of some texts in one buffer, separated by single spaces."""

    buffer: bytes
    counts: np.ndarray  # words of each text

    @classmethod
    def of(cls, texts: Sequence[bytes | None], lower: bytes | None = None) -> Words:
        """``lower``: a translation table applied before the words are cut."""
        counts, parts = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            words = (text.translate(lower) if lower else text).split() if text else None
            if words:
                counts[i] = len(words)
                parts.append(b" ".join(words))
        return cls(b" ".join(parts), counts)

    @classmethod
    def spaced(cls, texts: Sequence[bytes]) -> Words:
        """Of texts that have words, with single spaces between them."""
        counts = np.fromiter((text.count(b" ") + 1 for text in texts), np.int64, len(texts))
        return cls(b" ".join(texts), counts)

    @cached_property
    def bytes(self) -> np.ndarray:
        return np.frombuffer(self.buffer, np.uint8)

    @cached_property
    def _gaps(self) -> np.ndarray:
        return np.flatnonzero(self.bytes == 32)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self._gaps + 1]) if self.buffer else np.empty(0, np.int64)

    @cached_property
    def ends(self) -> np.ndarray:
        return np.concatenate([self._gaps, [len(self.buffer)]]) if self.buffer else np.empty(0, np.int64)

    @cached_property
    def first(self) -> np.ndarray:
        """The place of each text's first word, then the number of words."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    @cached_property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.bytes, self.starts, self.ends)

    def windows(self, size: int) -> np.ndarray:
        """Places of the first word of each run of ``size`` words inside one text."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(left >= size)

    def window_hashes(self, size: int, at: np.ndarray) -> np.ndarray:
        return span_hashes(self.hashes, at, at + size)

    def slice(self, start: int, words: int) -> bytes:
        return self.buffer[self.starts[start] : self.ends[start + words - 1]]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> bool:
    """Whether the spans at ``a`` and ``b`` are equal, all of them; in blocks of bounded memory."""
    for at in range(0, len(a), 16384):
        n = length[at : at + 16384]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(
            data[np.repeat(a[at : at + 16384], n) + within], data[np.repeat(b[at : at + 16384], n) + within]
        ):
            return False
    return True


def classes(words: Words, size: int, at: np.ndarray) -> np.ndarray:
    """A number for each window, equal exactly for windows of equal words.

    Windows are sorted by hash; neighbours with one hash are compared byte by
    byte. Should two different windows ever share a hash, all are numbered by
    their bytes instead.
    """
    if not len(at):
        return np.empty(0, np.int64)
    hashes = words.window_hashes(size, at)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts, ends = words.starts[at[order]], words.ends[at[order] + size - 1]
    again = np.flatnonzero(~new)
    length = ends - starts
    if np.array_equal(length[again], length[again - 1]) and _same_bytes(
        words.bytes, starts[again], starts[again - 1], length[again]
    ):
        out = np.empty(len(at), np.int64)
        out[order] = np.cumsum(new) - 1
        return out
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(words.slice(place, size), len(numbers)) for place in at.tolist()], np.int64)


def covered(total: int, at: np.ndarray, size: int) -> np.ndarray:
    """Which of ``total`` places lie in a span of ``size`` that starts at one of ``at``."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return np.cumsum(steps[:-1]) > 0


def binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Ranges of consecutive texts of about ``most`` bytes, one text at least, and these texts in UTF-8."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = size = 0
    for i, n in enumerate([*sizes, most + 1]):
        if i == len(sizes) or size and size + n > most:
            if i > start:
                yield start, i, binary(texts.slice(start, i - start))
            start, size = i, 0
        size += n
