"""Vectorised byte, word and window kernels used inside tasks. All take a slice of documents as one byte buffer.

Hashes are polynomials over random 64-bit values modulo 2**64 with an odd base, taken from prefix sums, so that the hash of
any byte or word range costs two lookups. They are finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    up, down = _POWERS.get(base, (np.zeros(0, U), None))
    if len(up) < n:
        n = -(-n // (1 << 16)) << 16
        up, down = np.full(n, base, U), np.full(n, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        _POWERS[base] = up, down
    return up, down


class Ranges:
    """Hashes of ranges [start, end) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        up, self.down = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) ^ (end - start).astype(U))

    def windows(self, size: int) -> np.ndarray:
        """The hash of [i, i + size) for every i that has one."""
        n = max(len(self.sums) - size, 0)
        return mix(((self.sums[size : size + n] - self.sums[:n]) * self.down[:n]) ^ U(size))


def byte_ranges(buf: np.ndarray) -> Ranges:
    return Ranges(_BYTE_VALUES[buf], _BASE)


def texts_of(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Texts as one array of binary values; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    return column


def slices(column: pa.ChunkedArray | pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents lo..hi as one byte buffer with their offsets; about ``limit`` bytes, or one longer document."""
    column = texts_of(column)
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice, or those between other bytes: start, end and document of each, first word of
    each document."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = SPACE) -> None:
        if lower:
            buf = LOWER[buf]
        self.buf, self.offsets = buf, offsets
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = ~between[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return byte_ranges(self.buf)(self.start, self.end)

    def ranges(self) -> Ranges:
        return Ranges(self.hashes(), _WORD_BASE)

    def one_document(self, size: int) -> np.ndarray:
        """Whether the window of ``size`` words from i lies in one document, for every i that has a window."""
        n = max(len(self) - size + 1, 0)
        return self.doc[:n] == self.doc[size - 1 : size - 1 + n]


def any_ahead(flags: np.ndarray, size: int) -> np.ndarray:
    """out[i] = any(flags[i : i + size])."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[np.minimum(np.arange(len(flags)) + size, len(flags))] > sums[:-1]


def covered(starts: np.ndarray, sizes: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, start + size)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + sizes, -1)
    return np.cumsum(steps[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    steps = np.diff(padded)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
