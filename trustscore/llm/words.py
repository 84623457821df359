"""Words of whole Arrow text columns as numpy arrays: positions, hashes, hashes of word windows.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Hashes are polynomials modulo 2**64 over random byte values,
so the hash of any word or window comes from two prefix sums; they depend on content only. Some pairs of long words
built for it agree in such a polynomial, so words of over ``LONG_WORD`` bytes have an XXH3 hash instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 500_000
LONG_WORD = 64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95, 0x2545F4914F6CDD1D)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` powers of an odd base and of its inverse, modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < count:
        size = max(count, 1 << 16)
        tables = []
        for value in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, np.uint64(value), dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        known = _POWERS[base] = (tables[0], tables[1])
    return known


class RollingHash:
    """Hashes of windows of a sequence of 64-bit numbers."""

    def __init__(self, values: np.ndarray, base: int = 0):
        self._forward, self._back = _powers(_BASES[base], len(values) + 1)
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self._forward[: len(values)], out=self._sums[1:])

    def windows(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._back[starts]
        return mix(raw + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of some texts: byte positions in ``data``, hash and text number of each; word ranges of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    row: np.ndarray
    first: np.ndarray  # word index at which each text begins, and the end of the last


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column (null: empty) and the offsets of its rows."""
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(wide), b"" if wide == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, stop
        start = stop


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of consecutive texts; ``offsets`` are relative to ``data``."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    finishes = solid.copy()
    finishes[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    hashes = RollingHash(_BYTE_VALUE[data], 2).windows(starts, ends)
    for number in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[number] = xxhash.xxh3_64_intdigest(data[starts[number] : ends[number]].tobytes())
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, starts, ends, hashes, row, first)


def sliced_words(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for slices of a column that keep memory bounded."""
    data, offsets = text_buffer(column)
    for start, stop in slices(offsets, limit):
        part = offsets[start : stop + 1]
        yield start, stop, find_words(data[part[0] : part[-1]], part - part[0])


def repeat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(start, start + count)``."""
    total = int(counts.sum())
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + shift


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``values`` cut into lists of the given lengths."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
