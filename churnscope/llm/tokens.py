"""Words of Arrow text batches, found and hashed with whole-array numpy steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are runs of ASCII letters, digits and all code points above U+007F;
#: A-Z count as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[65:91] = WORD[128:] = True

_MUL = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's UTF-8 bytes and its n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``most`` bytes (or one row): first row, end row,
    bytes, offsets.  Bounds the memory of the whole-array steps."""
    data, offsets = buffers(col)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses a row's edge."""
    n = len(data)
    inside = WORD[data]
    fresh, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    fresh[offsets[:-1]] = True
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    fresh[1:n] |= ~inside[:-1] if n else False
    last[:n - 1] |= ~inside[1:] if n else False
    starts = np.flatnonzero(inside & fresh[:n])
    ends = np.flatnonzero(inside & last[:n]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum())) - np.repeat(first, lens)
    power = np.ones(int(lens.max()), np.uint64)
    power[1:] = _MUL
    power = np.cumprod(power)
    letters = LOWER[data[np.repeat(starts - first, lens) + np.arange(len(within))]].astype(np.uint64)
    h = np.add.reduceat(mix64(letters + np.uint64(1)) * power[within], first)
    return mix64(h ^ (lens.astype(np.uint64) << np.uint64(32)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the rows, in order."""
    starts, ends, rows = word_spans(data, offsets)
    return word_hashes(data, starts, ends), rows
