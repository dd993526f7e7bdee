"""Words, shingles and their 64-bit hashes, computed with numpy straight from Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are folded to a-z and nothing else is. A text's
shingles are its distinct runs of ``width`` words; a text with fewer words has its whole sequence as its one shingle;
one without words (empty or null) has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
SEGMENT = 1 << 18
_RADIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses modulo 2**64
_JOIN = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _RADIX)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SEGMENT)
        inverse = np.uint64(pow(int(_RADIX), -1, 1 << 64))
        up, down = np.full(size, _RADIX, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about CHUNK_BYTES; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    rows = len(column)
    if not rows:
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + rows + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; no word crosses a text's end."""
    solid = ~_SPACE[raw]
    starts, ends = solid.copy(), solid.copy()
    if len(raw):
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        starts[1:] &= ~solid[:-1] | edge[1:-1]
        ends[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash a word: prefix sums of a polynomial, cut into segments so that memory stays bounded."""
    out = np.empty(len(starts), np.uint64)
    low, i = _LOWER[raw], 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SEGMENT, side="right")))
        part = _BYTE[low[base : ends[j - 1]]]
        up, down = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, bounds): bounds[i]:bounds[i+1] are the shingles of text i, repeats included."""
    counts = np.diff(first)
    n = len(hashes)
    rolling = np.zeros(n, np.uint64)
    for j in range(width):
        m = max(0, n - j)
        rolling[:m] = rolling[:m] * _JOIN + hashes[j:]
    per_text = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(per_text)))
    index = np.repeat(first[:-1] - bounds[:-1], per_text) + np.arange(bounds[-1])
    out = rolling[index] + np.uint64(width)
    for short in np.flatnonzero((counts > 0) & (counts < width)):
        value = np.uint64(0)
        for h in hashes[first[short] : first[short + 1]]:
            value = value * _JOIN + h
        out[bounds[short]] = value + np.uint64(counts[short])
    return mix(out), bounds


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of an Arrow string column."""
    with np.errstate(over="ignore"):
        for row, raw, offsets in text_chunks(column):
            starts, ends = word_spans(raw, offsets)
            first = np.searchsorted(starts, offsets)
            values, bounds = shingle_hashes(word_hashes(raw, starts, ends), first, width)
            for i in range(len(offsets) - 1):
                one = np.sort(values[bounds[i] : bounds[i + 1]])
                if len(one) > 1:
                    one = one[np.concatenate(([True], one[1:] != one[:-1]))]
                yield row + i, one
