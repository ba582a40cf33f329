"""Words, word hashes and shingle sets of whole texts, computed per Arrow batch with numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only. Hashes are 64 bits wide; equal
hashes are taken as equal words or shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
STEPS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93))
SLICE_BYTES = 1 << 21

_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * STEPS[0]
    x = (x ^ (x >> np.uint64(27))) * STEPS[1]
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    back = [np.uint64(pow(int(step), -1, 1 << 64)) for step in STEPS[:2]]
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * back[1]
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * back[0]
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def powers(n: int) -> np.ndarray:
    """At least n powers of BASE modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), BASE)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row bounds in them), of about ``limit`` bytes each; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        yield first, end, data[bounds[first]:bounds[end]], bounds[first:end + 1] - bounds[first]
        first = end


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and for each row the index of its first word (one more than rows)."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    first[inner] = solid[inner]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    kept = LOWER[data[solid]].astype(np.uint64)
    starts = np.cumsum(solid)[at] - 1
    lengths = np.diff(starts, append=len(kept))
    place = np.arange(len(kept)) - np.repeat(starts, lengths)
    kept += np.uint64(1)
    kept *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(kept, starts) + lengths.astype(np.uint64)), np.searchsorted(at, bounds)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole run if it is shorter."""
    if not len(words):
        return words
    width = min(size, len(words))
    many = len(words) - width + 1
    total = np.full(many, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        total += words[k:k + many] * (STEPS[k % 3] + np.uint64(2 * (k // 3)))
        total = mix(total) if k + 1 < width else total
    return np.unique(mix(total))


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a text column."""
    for first, end, data, bounds in text_slices(column):
        words, at = word_hashes(data, bounds)
        for row in range(first, end):
            yield row, shingle_set(words[at[row - first]:at[row - first + 1]], size)
