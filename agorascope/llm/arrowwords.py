"""Words of whole Arrow batches as hashes, with vector operations on the batch's bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its hash is a polynomial of its
bytes modulo 2**64, taken from running sums over the batch and mixed; equal words have equal hashes
in every batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_P, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = tuple(out)
    return _powers


@dataclass
class Words:
    hashes: np.ndarray  # of all words of the batch, in order
    first: np.ndarray  # row i has words first[i] to first[i + 1]
    begin: np.ndarray  # byte range of each word in ``data``
    end: np.ndarray
    data: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()


def words(column: pa.Array, fold: bool = False) -> Words:
    """Words of a string column; nulls have none. ``fold``: with A-Z as a-z."""
    column = column.cast(pa.large_string())
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8, high - low, low) if buffer and high > low else np.zeros(0, np.uint8)
    bounds = offsets - low
    if fold:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inner = (data != 32) & ((data < 9) | (data > 13))
    starts = inner.copy()
    starts[1:] &= ~inner[:-1]
    at = bounds[:-1][np.diff(bounds) > 0]
    starts[at] = inner[at]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:]
    at = bounds[1:][np.diff(bounds) > 0] - 1
    ends[at] = inner[at]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = np.zeros(len(begin), np.uint64)
    step = 1 << 22  # bytes per piece, so that powers and sums stay small
    for lo in range(0, len(data), step):
        a, b = np.searchsorted(begin, [lo, lo + step])
        if a == b:
            continue
        stop = int(end[b - 1])
        up, down = _power(stop - lo + 1)
        sums = np.zeros(stop - lo + 1, np.uint64)
        np.cumsum((data[lo:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - lo], out=sums[1:])
        part = sums[end[a:b] - lo] - sums[begin[a:b] - lo]
        # the length keeps words apart that differ by what the polynomial cannot see
        hashes[a:b] = mix(part * down[begin[a:b] - lo] + (end[a:b] - begin[a:b]).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
    return Words(hashes, np.searchsorted(begin, bounds), begin, end, data)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, for each start; n - 1 fewer than words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x2545F4914F6CDD1D) + hashes[i : i + count]
    return mix(out)
