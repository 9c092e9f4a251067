"""Vectorised word splitting and hashing over Arrow batches.

A batch's texts lie in one byte buffer. Words are maximal runs of word bytes within a document;
a word's hash is a polynomial over its bytes, taken from prefix sums, and then mixed; a run of
words is hashed in the same way over the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes that one pass handles at a time (one longer text is handled alone).
BLOCK_BYTES = 1 << 20

#: Bytes that end a word: space and tab to carriage return.
WHITE = (0x20, *range(0x09, 0x0E))

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def white_words() -> np.ndarray:
    """True for bytes that belong to a word `[^\\x20\\x09-\\x0D]+`."""
    out = np.ones(256, bool)
    out[list(WHITE)] = False
    return out


@cache
def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    if fold:
        values[65:91] = values[97:123]
    return values


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 12)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 2 * BLOCK_BYTES:
            _POWERS[base] = have
    return have


def runs_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hash of values[start:end] for each pair; equal content, equal hash."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    out = (total[end] - total[start]) * down[start]
    return mix(out + (end - start).astype(np.uint64))


WORD_BASE, RUN_BASE, SPAN_BASE = 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


class Words:
    """Words of a block of documents: byte spans, hashes, and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, fold: bool):
        inside = word_bytes[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[offsets] = False
        self.data, self.fold = data, fold
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.bounds)
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = runs_hash(_byte_values(self.fold)[self.data], self.start, self.end, WORD_BASE)
        return self._hash

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def grams(self, k: int, base: int = RUN_BASE) -> np.ndarray:
        """Hash of the k words from each position (also across documents; see `whole`)."""
        n = max(0, len(self.start) - k + 1)
        at = np.arange(n)
        return runs_hash(self.hash, at, at + k, base)

    def whole(self, k: int) -> np.ndarray:
        """Positions whose next k words lie in one document."""
        n = max(0, len(self.start) - k + 1)
        left = np.repeat(self.bounds[1:], self.n)[:n] - np.arange(n)
        return np.flatnonzero(left >= k)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for consecutive rows of at most BLOCK_BYTES bytes."""
    data, offsets = _bytes_of(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_blocks(column: pa.Array, fold: bool = False, word_bytes: np.ndarray | None = None):
    """(first row, last row, Words) over a column of texts."""
    kinds = white_words() if word_bytes is None else word_bytes
    for at, to, data, offsets in text_blocks(column):
        yield at, to, Words(data, offsets, kinds, fold)
