"""Vectorised word and window hashing over blocks of UTF-8 texts.

A block holds the bytes of many documents one after another.  Ranges of bytes are hashed by polynomials
modulo the prime 2**61 - 1, taken from prefix sums, so the hash of any word or line costs a few operations.
(Modulo 2**64 there would be texts that collide whatever the base is, such as Thue-Morse words; modulo a
prime two different ranges of n bytes collide for n of 2**61 bases at most.)  Windows of a few words are
mixed word by word.  ``same_ranges`` compares bytes where equality must be certain.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PRIME = np.uint64(2**61 - 1)
BASE = 0x1B3F5A7C9D2E4681
KEPT = 1 << 21  # powers kept by a worker
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOW31, LOW30 = np.uint64(2**31 - 1), np.uint64(2**30 - 1)
U30, U31, U61 = np.uint64(30), np.uint64(31), np.uint64(61)
ODD = np.uint64(0x9E3779B97F4A7C15)


def folded(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & PRIME) + (x >> U61)
    return np.where(x >= PRIME, x - PRIME, x)


def shifted(x: np.ndarray) -> np.ndarray:
    """2**31 times numbers below 2**61, folded once."""
    return ((x & LOW30) << U31) + (x >> U30)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime."""
    a1, a0, b1, b0 = a >> U31, a & LOW31, b >> U31, b & LOW31
    return folded(np.uint64(2) * a1 * b1 + shifted(a1 * b0 + a0 * b1) + a0 * b0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` (or more) powers of the base and of its inverse."""
    return _powers(KEPT) if n <= KEPT else _powers.__wrapped__(n)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, int(PRIME))):
        p, size = np.ones(n, np.uint64), 1
        while size < n:
            more = min(size, n - size)
            p[size : size + more] = times(p[:more], np.uint64(pow(base, size, int(PRIME))))
            size += more
        out.append(p)
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Ranges:
    """Hashes of ranges of a sequence of bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        up, value = up[: len(raw)], raw.astype(np.uint64) + np.uint64(1)
        high, low = (up >> U31) * value, (up & LOW31) * value  # of 40 bits
        if len(raw) > 1 << 23:  # else their sums have 63 bits
            term = folded(shifted(high) + low)
            high, low = term >> U31, term & LOW31
        self.high, self.low = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (high, low))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = self.high[end] - self.high[start], self.low[end] - self.low[start]
        return mix(times(folded(shifted(folded(high)) + folded(low)), self.down[start]))


def sequences(words: np.ndarray, start: np.ndarray, count: np.ndarray | int, size: int) -> np.ndarray:
    """Hashes of runs of ``count`` (``size`` at most) numbers from ``start``."""
    out = mix(np.full(len(start), 0, np.uint64) + np.asarray(count).astype(np.uint64) * ODD)
    for j in range(size):
        here = slice(None) if np.isscalar(count) else np.flatnonzero(count > j)
        out[here] = mix(out[here] * ODD + words[start[here] + j])
    return out


def same_ranges(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from places a and b are equal, for ``size`` bytes each."""
    out = np.ones(len(a), bool)
    if len(a):
        at = np.cumsum(size) - size
        offset = np.arange(int(size.sum())) - np.repeat(at, size)
        differ = raw[np.repeat(a, size) + offset] != raw[np.repeat(b, size) + offset]
        out[np.repeat(np.arange(len(a)), size)[differ]] = False
    return out


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


class Block:
    """Documents of one column: bytes, words (start, end, document) and their hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.raw, self.at = texts_of(column)
        self.n = len(column)
        if lower:
            self.raw = LOWER[self.raw]
        inside = ~SPACE[self.raw]
        edge = np.zeros(len(self.raw) + 1, bool)
        if len(self.raw):
            edge[0] = inside[0]
            edge[1:-1] = inside[1:] != inside[:-1]
            edge[-1] = inside[-1]
            # a document's border ends a word too
            border = self.at[1:-1]
            border = np.unique(border[(border > 0) & (border < len(self.raw))])
            both = border[inside[border] & inside[border - 1]]
        else:
            both = np.empty(0, np.int64)
        edges = np.flatnonzero(edge)
        if len(both):
            edges = np.sort(np.concatenate([edges, both, both]))
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.at).astype(np.int64)  # first word of each document, and the end
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.count)
        self.inside = inside
        self._bytes = None

    @property
    def bytes(self) -> Ranges:
        if self._bytes is None:
            self._bytes = Ranges(self.raw)
        return self._bytes

    def word_hashes(self) -> np.ndarray:
        return self.bytes(self.start, self.end)

    def windows(self, size: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) and hashes of all windows of ``size`` words within a document."""
        last = np.repeat(self.first[1:], self.count)
        start = np.flatnonzero(np.arange(len(words)) + size <= last)
        return start, sequences(words, start, size, size)


def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive places of ``at``."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]
