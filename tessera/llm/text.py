"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs without ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased.
All functions work on the UTF-8 bytes of many documents at once, so Python
costs are per block of text, not per word.  Hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COMBINE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which the worker hands freed memory back: workers serve many tasks."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64), dtype=np.uint64)
    return _POWERS


_POWERS = np.empty(0, np.uint64)
_powers(4096)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes; one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; no word crosses a document's end."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~_SPACE[raw]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = False, False
    edge[1:n] = inside[:-1] & inside[1:]
    cuts = offsets[1:-1]
    edge[cuts] = False
    starts = np.flatnonzero(inside & ~edge[:n])
    ends = np.flatnonzero(inside & ~edge[1:]) + 1
    return starts, ends


def _hash_block(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    value = _BYTE[_LOWER[raw[at]]]
    value *= _powers(int(lens.max()) + 1)[pos]
    return mix(np.add.reduceat(value, first))


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word; blocks bound the working memory."""
    if not len(starts):
        return np.empty(0, np.uint64)
    out, first = [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK_BYTES)))
        out.append(_hash_block(raw, starts[first:last], ends[first:last]))
        first = last
    return np.concatenate(out)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each document where its words begin."""
    starts, ends = word_spans(raw, offsets)
    return hash_words(raw, starts, ends), np.searchsorted(starts, offsets)


def shingle_starts(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every n-word shingle, and where each document's shingles begin."""
    count = np.diff(at)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate(([0], np.cumsum(made)))
    return np.repeat(at[:-1], made) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], made), out_at


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, with repeats, and where each document's begin.

    A document of fewer words has its whole sequence as one shingle; one
    without words has none.
    """
    count = np.diff(at)
    first, out_at = shingle_starts(at, n)
    total = np.zeros(len(hashes), np.uint64)
    for k in range(min(n, len(hashes))):
        total[: len(hashes) - k] += hashes[k:] * _COMBINE[k]
    out = total[first] if len(first) else np.empty(0, np.uint64)
    for d in np.flatnonzero((count > 0) & (count < n)):
        own = hashes[at[d] : at[d + 1]]
        out[out_at[d]] = (own * _COMBINE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), out_at


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each document, its distinct shingle hashes in ascending order."""
    raw, offsets = utf8(column)
    for a, b in blocks(offsets):
        own = offsets[a : b + 1] - offsets[a]
        h, at = words(raw[offsets[a] : offsets[b]], own)
        s, s_at = shingles(h, at, n)
        for d in range(b - a):
            yield np.unique(s[s_at[d] : s_at[d + 1]])
