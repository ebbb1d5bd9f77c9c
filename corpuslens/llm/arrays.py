"""Numpy views of Arrow text columns: words, hashes and shingles without a Python object per word.

A text column is one byte buffer and its offsets. Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``;
all of these are single bytes in UTF-8, so no decoding is needed. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once. A longer text is still worked on whole, but what takes memory per byte goes in parts of it.
SLICE_BYTES = 1 << 20
#: Byte ranges or sequences hashed at once, and the values that are mixed in turn: longer ones go through BLAKE2b.
HASH_RANGES, HASH_TURNS = 1 << 17, 64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
IN_LINE = np.arange(256) != 10
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_SEEDS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values, so that any of their bits may be used."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(wide, pa.ChunkedArray):
        wide = pa.concat_arrays(wide.chunks)
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    data = wide.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of record batches with the bytes and offsets of one text column."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        for i, j in slices(offsets, limit):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, which the C library else keeps for a worker that may never need it again."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def spans(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are True in a table of 256, which no row boundary crosses."""
    starts, ends, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], len(data)
    for a in range(0, n, SLICE_BYTES):
        b = min(a + SLICE_BYTES, n)
        solid = table[data[max(a - 1, 0) : b + 1]]
        own = solid[a > 0 :][: b - a]
        before, after = np.ones(b - a, bool), np.ones(b - a, bool)
        before[a == 0 :] = ~solid[: b - a - (a == 0)]
        after[: len(solid) - (a > 0) - 1] = ~solid[(a > 0) + 1 :]
        before[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a] = True
        after[offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "right")] - 1 - a] = True
        starts.append(np.flatnonzero(own & before) + a)
        ends.append(np.flatnonzero(own & after) + a + 1)
    return np.concatenate(starts), np.concatenate(ends)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (one more) the number of words before it."""
    starts, ends = spans(~SPACE, data, offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a 64-bit value; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))


def chained(size: np.ndarray, value: Callable[[np.ndarray, int], np.ndarray], blob: Callable[[int], bytes], turns: int) -> np.ndarray:
    """Hashes of sequences of ``size`` values, mixed in one after the other; ``value`` gives those of some sequences at a turn,
    ``blob`` the bytes of a whole sequence of more than ``turns``."""
    out = size.astype(np.uint64) * _SEEDS[63]
    for a in range(0, len(size), HASH_RANGES):
        part = slice(a, a + HASH_RANGES)
        left, turn = np.flatnonzero((size[part] > 0) & (size[part] <= turns)) + a, 0
        while len(left):
            out[left] = mix(out[left] * _SEEDS[60] + value(left, turn))
            turn += 1
            left = left[size[left] > turn]
    for k in np.flatnonzero(size > turns).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(blob(k), digest_size=8).digest(), "little")
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time."""
    at, length = eights(data), ends - starts
    value = lambda k, turn: at[starts[k] + 8 * turn] & _MASK[np.minimum(length[k] - 8 * turn, 8)]
    hashes = chained(-(-length // 8), value, lambda k: data[starts[k] : ends[k]].tobytes(), HASH_TURNS)
    return mix(hashes + length.astype(np.uint64))


def sequence_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of 64-bit values."""
    return mix(chained(last - first, lambda k, turn: values[first[k] + turn], lambda k: values[first[k] : last[k]].tobytes(), HASH_TURNS))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, and for each row (one more) the number before it."""
    n = len(hashes)
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    if n < size:
        return np.empty(0, np.uint64), first
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h += hashes[k : n - size + 1 + k] * _SEEDS[k]
        h ^= h >> np.uint64(29)
    keep = np.zeros(n - size + 1, bool)
    at = bounds[:-1][counts > 0]
    reach = counts[counts > 0]
    keep[np.repeat(at - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())] = True
    return mix(h[keep]), first


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash for a sequence of words that is shorter than a window."""
    return sequence_hashes(hashes, np.zeros(1, np.int64), np.array([len(hashes)]))[0] ^ _SEEDS[62]


def count_between(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many are True between each two bounds."""
    out = np.zeros(len(bounds) - 1, np.int64)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        out[some] = np.add.reduceat(mask[: bounds[-1]].view(np.uint8), bounds[some], dtype=np.int64)
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text in UTF-8."""
    return count_between((data & 0xC0) != 0x80, offsets)
