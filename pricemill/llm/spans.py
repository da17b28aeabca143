"""Hashes of many spans of a byte buffer at once, for code that runs inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Text bytes handled at once; a longer single text is handled alone.
CHUNK_BYTES = 2 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finalizer of a public 64-bit generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """Polynomial hashes modulo 2**64: powers are kept between buffers."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            ones = np.ones(n, np.uint64)
            ones[1:] = BASE
            self.powers = np.cumprod(ones)
            ones[1:] = INVERSE
            self.inverses = np.cumprod(ones)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each span ``data[start:end]``, the same wherever the span lies."""
        n = len(data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        value = (sums[ends] - sums[starts]) * self.inverses[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of successive runs of a string column; a null text has no bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    payload = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield at, payload[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run without separator bytes, and the row it lies in."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    inside = ~is_space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(offsets, at, side="right") - 1
