"""Texts in tasks: views of Arrow batches as bytes, and words as hash values.

A text column of a batch is one byte buffer with offsets, so the work on a
batch is done with numpy over the buffer, not per word in Python. A batch is
cut into slices of bounded bytes first; a single text longer than that makes a
slice of its own.
"""

import ctypes

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass takes at once.
SLICE_BYTES = 500_000

#: A worker lives through many tasks. Large arrays are mapped on their own, so
#: that freeing them gives the memory back at once (glibc; elsewhere no change).
LARGE_ARRAY, _M_MMAP_THRESHOLD = 1 << 18, -3
if hasattr(ctypes.CDLL(None), "mallopt"):
    ctypes.CDLL(None).mallopt(_M_MMAP_THRESHOLD, LARGE_ARRAY)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_MULT = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null has no bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (i, j) of about `limit` bytes each, at least one row."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), rows)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> np.ndarray:
    """At least n powers of the multiplier, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        _powers = np.cumprod(np.full(size, _MULT), dtype=np.uint64)
    return _powers


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words `[^\\x20\\x09-\\x0D]+` begin and end, and each one's row.

    `space` marks the bytes that stand between words.
    """
    solid = ~space[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = offsets[1:-1]  # a word also ends where its text does
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = solid[edge]
    ends[edge - 1] = solid[edge - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(offsets, first, "right") - 1


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit value for each word; `lower` folds A-Z."""
    if not len(first):
        return np.zeros(0, np.uint64)
    length = last - first
    ends = np.cumsum(length)
    begins = ends - length
    place = np.arange(ends[-1]) - np.repeat(begins, length)
    spelled = (_LOWER if lower else _BYTE)[data[place + np.repeat(first, length)]]
    spelled *= powers(int(length.max()))[place]
    return mix(np.add.reduceat(spelled, begins) + length.astype(np.uint64))


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between each pair of offsets."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


_PLACES = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, value) of each run of `size` words inside one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value += hashes[k:k + n] * _PLACES[k]
    start = np.flatnonzero(row[:n] == row[size - 1:])
    return start, mix(value[start])
