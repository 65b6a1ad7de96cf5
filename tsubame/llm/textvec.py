"""Words and shingles of many texts at once, as numpy arrays over UTF-8 bytes.

Words are maximal runs of bytes other than space, tab, newline, vertical tab, form
feed and carriage return, after lower-casing A-Z. A word's 64-bit hash is the mixed sum
of a random value for each (place, byte); ``span_hash``, for spans that overlap, is a
polynomial of random byte values, then mixed. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
PLACES = 64
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    """Invertible mixing of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(_M1)
    x ^= x >> U(27)
    x *= U(_M2)
    x ^= x >> U(31)
    return x


@cache
def odd(i: int) -> np.uint64:
    return U(int(mix(np.array([i + 1], dtype=U) * U(_BASE))[0]) | 1)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; far cheaper than numpy's hashing ``unique``."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


class Tables:
    """Byte values and powers, grown to the longest chunk seen by this worker."""

    def __init__(self) -> None:
        self.byte = mix((np.arange(256, dtype=U) + U(1)) * U(_BASE))
        fold = np.arange(256)
        fold[65:91] += 32
        self.folded = self.byte[fold]
        # One value for each place in a word and byte; places from PLACES - 1 on are mixed in.
        self.placed = mix((np.arange(PLACES << 8, dtype=U) + U(1_000)) * U(_BASE))
        self.placed_folded = self.placed.reshape(PLACES, 256)[:, fold].ravel()
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
        self.power = self.inverse = np.ones(1, dtype=U)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, CHUNK_BYTES + 1)
            inv = pow(_BASE, -1, 1 << 64)
            self.power = np.cumprod(np.concatenate([[U(1)], np.full(n, _BASE, dtype=U)]))
            self.inverse = np.cumprod(np.concatenate([[U(1)], np.full(n, inv, dtype=U)]))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.fill_null("").cast(pa.large_string())
    else:
        col = col.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    data, at = buffers(col)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_bounds(data: np.ndarray, at: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (with the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    gap = t.space[data]
    edge = at[:-1][at[:-1] < at[1:]]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    before[edge] = True
    after[-1], after[:-1] = True, gap[1:]
    after[edge[1:] - 1] = True
    word = ~gap
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, t: Tables) -> np.ndarray:
    """Hash of each span of the bytes whose table values are given."""
    n = len(values)
    t.grow(n + 1)
    total = np.empty(n + 1, dtype=U)
    total[0] = 0
    np.cumsum(values * t.power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * t.inverse[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, at: np.ndarray, t: Tables, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's first word (with the end)."""
    starts, ends, first = word_bounds(data, at, t)
    return _word_hash(data, starts, ends, t.placed_folded if fold else t.placed), first


def _word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, placed: np.ndarray) -> np.ndarray:
    """Hash of each of these spans, which do not overlap and stand in order."""
    size = ends - starts
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    byte = data[place + np.repeat(starts, size)]
    value = placed[(np.minimum(place, PLACES - 1) << 8) | byte]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        value[far] = mix(value[far] + place[far].astype(U) * U(_BASE))
    total = np.zeros(len(value) + 1, dtype=U)
    np.cumsum(value, out=total[1:])
    return mix(total[begin + size] - total[begin] + size.astype(U))


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All k-word shingles, text by text, and each text's first shingle (with the end).

    A text of fewer words, but one at least, has its whole sequence as one shingle.
    """
    n = np.diff(first)
    full = np.maximum(n - k + 1, 0)
    if len(words) >= k:
        run = words[: len(words) - k + 1] * odd(0)
        for j in range(1, k):
            run = run + words[j : len(words) - k + 1 + j] * odd(j)
        run = mix(run)
    else:
        run = np.zeros(0, dtype=U)
    count = np.where(full > 0, full, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), full)
    out = np.empty(begin[-1], dtype=U)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    out[begin[:-1][doc] + inside] = run[first[:-1][doc] + inside]
    for i in np.flatnonzero((n > 0) & (full == 0)):
        w = words[first[i] : first[i + 1]]
        out[begin[i]] = mix(np.array([sum(int(x) * int(odd(100 * len(w) + j)) for j, x in enumerate(w)) % (1 << 64)], dtype=U))[0]
    return out, begin
