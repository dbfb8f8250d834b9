"""Column-at-a-time helpers on Arrow text columns: slices of bounded size, words as byte ranges, and hashes of them.

A text column is handled as one byte array plus offsets, so that splitting, hashing and window minima are a few numpy
passes over a slice and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: Odd multipliers of the mixing and polynomial hashes below.
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1

#: Bytes of words that end at blanks: all but space and \t to \r.
NON_BLANK = np.ones(256, bool)
NON_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits: 0-9, a-z (and A-Z, which callers lower), and every byte of a longer code point.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)


def _chain(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse; kept between slices up to a few MB."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(self.up):
            return self.up[:n], self.down[:n]
        up, down = _chain(_BASE, n), _chain(pow(_BASE, -1, 1 << 64), n)
        if n <= 4 * SLICE_BYTES:
            self.up, self.down = up, down
        return up, down


_POWERS = _Powers()


class Prefix:
    """Hashes of any range of a sequence of 64-bit values, from one running sum."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = _POWERS.get(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k values from each place where k are left."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``most`` bytes of text, or one row if that is longer."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a text column, offsets from 0; null is empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.fill_null(b"" if kind == pa.large_binary() else "").cast(kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """Words of every text of a slice: byte ranges ``start``/``end`` and, by text, their range ``first[i]:first[i+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        inside = table[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before &= ~edge[:-1]
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.data, self.inside = data, inside
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        within = np.arange(len(self.data), dtype=np.int32)
        gap = np.diff(self.start, append=len(self.data))
        within[self.start[0] :] -= np.repeat(self.start.astype(np.int32), gap)
        np.clip(within, 0, int(length.max()), out=within)
        up = _chain(_BASE, int(length.max()) + 1)
        values = _BYTE[self.data]
        values *= up[within]
        values[~self.inside] = 0
        return mix(np.add.reduceat(values, self.start) + length.astype(np.uint64) * _MUL)


def sliding_first_min(key: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest key among each ``width`` neighbours, the first if equal; keys count by their upper 32 bits."""
    packed = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    done = 1
    while done < width:
        shift = min(done, width - done)
        packed = np.minimum(packed[:-shift], packed[shift:])
        done += shift
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any of the ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def long_array(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed long."""
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
