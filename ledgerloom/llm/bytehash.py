"""Hashes of substrings and words over the byte buffers of Arrow columns, without a Python loop over texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
#: Odd factors of the two rolling hashes, and a value for every byte.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
VALUES = np.random.default_rng(7).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each factor its powers and those of its inverse, up to n."""
    if not _powers or len(_powers[0][0]) <= n:
        size = max(n + 1, 2 * CHUNK)
        made = []
        for factor in FACTORS:
            pair = []
            for base in (factor, pow(factor, -1, 1 << 64)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                pair.append(np.cumprod(p))
            made.append((pair[0], pair[1]))
        _powers[:] = made
    return _powers


class Rolling:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray, which: tuple[int, ...] = (0, 1)):
        self.sums = {}
        for k in which:
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(VALUES[k][data] * powers(len(data))[k][0][: len(data)], out=sums[1:])
            self.sums[k] = sums

    def of(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        h = (self.sums[k][end] - self.sums[k][start]) * powers(0)[k][1][start]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its rows."""
    array = batch.column(column)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, min(j, n)
        i = j


#: Lower case for A-Z; letters, digits and all bytes of longer UTF-8 sequences make up words.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the lower-cased texts; offsets start at 0 and cover data."""
    data = LOWER[data]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = IN_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = np.flatnonzero(inside & (first[:-1] | ~np.r_[False, inside[:-1]]))
    end = np.flatnonzero(inside & (first[1:] | ~np.r_[inside[1:], False])) + 1
    return Rolling(data, (0,)).of(start, end, 0), np.searchsorted(offsets, start, "right") - 1
