"""Vectorised scanning and hashing of UTF-8 text held in Arrow columns.

Everything works on the column's own byte buffer, a slice of rows at a time, so the memory
a task needs is set by ``SLICE_BYTES`` and the longest single text, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))

#: Words are maximal runs of bytes outside space and 0x09-0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, _BASE if which == "up" else _INVERSE, _U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:
            _powers[which] = have
    return have[:n]


class PrefixHash:
    """Polynomial prefix hashes (mod 2**64) of a sequence; any span hashes in constant time."""

    def __init__(self, values: np.ndarray):
        v = _TABLE[values] if values.dtype == np.uint8 else values.copy()
        v *= _power("up", len(v))
        self.prefix = np.empty(len(v) + 1, _U)
        self.prefix[0] = 0
        np.cumsum(v, out=self.prefix[1:])

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of values[start:stop] for arrays of bounds, independent of position."""
        h = self.prefix[stop] - self.prefix[start]
        h *= _power("down", len(self.prefix))[start]
        return mix(h)

    def windows(self, n: int) -> np.ndarray:
        """Hash of each run of n values."""
        count = max(0, len(self.prefix) - n)
        h = self.prefix[n:] - self.prefix[:count]
        h *= _power("down", count) if count else 1
        return mix(h)


class TextSlice(NamedTuple):
    first: int
    stop: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than rows


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """Cut a string column into runs of rows of about ``limit`` bytes. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, body = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        stop = min(max(stop, at + 1), len(column))
        yield TextSlice(at, stop, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


class Words(NamedTuple):
    start: np.ndarray
    stop: np.ndarray
    offsets: np.ndarray  # index of each row's first word; one more than rows


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Byte bounds of the words of each row; no word crosses rows."""
    solid = ~_SPACE[data]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[first] = solid[first]
    ends[:-1] &= ~solid[1:]
    ends[last] = solid[last]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over each row's span (int64)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, dtype=np.int64, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
