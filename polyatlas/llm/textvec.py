"""Vectorised text primitives over Arrow string buffers.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, so
a word never spans two documents. Everything here is numpy over a whole Arrow
batch; there is no per-row Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
#: The multiplier of each place of a range is drawn anew; powers of one base would hash some long patterns alike.
_PLACES = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]
_BASES = [np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)]
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
for _v in _BYTE_VALUES:
    _v[WHITESPACE] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that close inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, dtype=np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(to, rows)
        row = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte range of each word, and for each text the index of its first word."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white = WHITESPACE[data]
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0], before[1:] = True, white[:-1]
    after[-1], after[:-1] = True, white[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    solid = ~white
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0, block: int = 1 << 20, gaps: bool = False) -> np.ndarray:
    """A 64-bit hash of each disjoint ascending byte range; white space counts as zero. gaps: other bytes than white space may stand between the ranges."""
    out, values = np.zeros(len(start), dtype=np.uint64), _BYTE_VALUES[which]
    i, factors = 0, np.zeros(0, dtype=np.uint64)
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, side="right")))
        s, e = start[i:j] - start[i], end[i:j] - start[i]
        longest = int((e - s).max())
        if len(factors) < longest:
            factors = mix((np.arange(longest, dtype=np.uint64) + np.uint64(1)) * _PLACES[which]) | np.uint64(1)
        place = np.arange(int(e[-1]), dtype=np.int64)
        held = np.diff(np.append(s, e[-1]))
        place -= np.repeat(s, held)
        outside = place >= np.repeat(e - s, held) if gaps else None
        np.minimum(place, longest - 1, out=place)
        part = values[data[start[i] : start[i] + e[-1]]] * factors[place]
        if gaps:
            part[outside] = 0
        out[i:j] = np.add.reduceat(part, s)
        i = j
    return mix(out + (end - start).astype(np.uint64) * _MIX[2])


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries, by doubling; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, power, step = None, 0, hashes, 1
    while True:
        if width & step:
            part = power[done : done + n] if done else power[:n]
            out = part.copy() if out is None else mix(out * _BASES[1] + part)
            done += step
        if done == width:
            return out
        power = mix(power[:-step] * _BASES[0] + power[step:])
        step *= 2


def fragment_rows(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
