"""Words and shingles of Arrow text columns as 64-bit hashes, computed on the UTF-8 bytes.

Everything works on slices of about ``CHUNK`` bytes, so memory follows the longest single text,
not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 500_000  # working arrays take some 100 bytes for each byte of a slice, and a worker keeps its peak
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE_CODES = np.random.default_rng(20_240_601).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) of consecutive rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of a slice: byte spans, the row each belongs to, and 64-bit hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = True, cut: np.ndarray | None = None):
        self.rows = len(offsets) - 1
        self.bytes = _LOWER[raw] if lower else raw
        inside = ~_SEPARATOR[self.bytes]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(raw)]
        opens[firsts] = inside[firsts]
        if cut is not None:
            opens |= cut & inside
        self.starts = np.flatnonzero(opens)
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        closes = np.empty(len(self.starts), np.int64)
        if len(self.starts):
            anchor = np.zeros(len(raw), np.int64)
            anchor[self.starts] = self.starts
            position = np.arange(len(raw)) - np.maximum.accumulate(anchor)
            position[~inside] = 0
            powers = np.full(int(position.max()) + 1, _BASE, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            value = _BYTE_CODES[self.bytes] * powers[position]
            value[~inside] = 0
            lengths = np.add.reduceat(inside.astype(np.int32), self.starts)
            closes = self.starts + lengths
            self.hash = mix(np.add.reduceat(value, self.starts) + lengths.astype(np.uint64) * _STEP)
        else:
            self.hash = np.zeros(0, np.uint64)
        self.ends = closes
        self.count = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, row offsets) of all runs of ``size`` words; a shorter text is one run."""
        runs = np.where(self.count >= size, self.count - size + 1, np.minimum(self.count, 1))
        offsets = np.concatenate([[0], np.cumsum(runs)])
        out = np.zeros(int(offsets[-1]), np.uint64)
        if not len(out):
            return out, offsets
        start = np.repeat(self.first[:-1] - offsets[:-1], runs) + np.arange(len(out))
        width = np.repeat(np.minimum(self.count, size), runs)
        padded = np.concatenate([self.hash, np.zeros(size, np.uint64)])
        for j in range(size):
            out = out * _STEP + np.where(j < width, padded[start + j], np.uint64(0))
        return mix(out + width.astype(np.uint64)), offsets


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each row."""
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def digest(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a sorted set."""
    n = np.array([len(values)], np.uint64)
    one = mix(np.add.reduce(mix(values * _BASE), dtype=np.uint64, keepdims=True) + n)
    two = mix(np.add.reduce(mix(values ^ _STEP), dtype=np.uint64, keepdims=True) ^ (n * _BASE))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])
