"""Whole batches of texts as flat byte arrays, and hashes of their pieces, in numpy.

A batch is taken in parts of whole documents of about PART bytes, so that memory follows the longest text, not the batch.
Hashes of runs are differences of one running sum of powers (mod 2**64), brought to a common power and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One odd 64-bit number for each byte value.
_r = np.random.default_rng(20240229)
BYTE = _r.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins and ends (n + 1 places); null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, ends


def parts(column: pa.Array, most: int = PART) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, ends from 0) of runs of whole texts of about `most` bytes, one text at least."""
    data, ends = flat(column)
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads what differs in h over all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64, for i up to n at least."""
    held = _tables.get(int(base))
    if held is None or len(held[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        back = np.uint64(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, back):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        held = _tables[int(base)] = (out[0], out[1])
    return held


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each start and end."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and which text's word it is the first (n + 1 places: text d has words first[d] to first[d + 1])."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[data]
    begin, end = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]  # at place i: a word begins, a word has ended
    edges = ends[1:-1]
    crossed = edges[inside[edges] & inside[edges + 1]]  # a text ends in a word and the next one begins in a word
    begin[crossed] = True
    end[crossed] = True
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end)
    return starts, stops, np.searchsorted(starts, ends)


def doc_of(first: np.ndarray, n: int) -> np.ndarray:
    """The text of each of n pieces, given first as from words()."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)
