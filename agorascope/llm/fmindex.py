"""FM-index over words: a Burrows-Wheeler transform held in a wavelet matrix, with backward search.

Suffixes are sorted by their first DEPTH words, which is all that patterns of up to DEPTH words need:
the rows that begin with such a pattern are contiguous, and a backward step counts exactly. Many
patterns are searched at once, one vector step per word.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence over [0, 2**levels)."""

    def __init__(self, sequence: np.ndarray, levels: int):
        self.levels, self.n = levels, len(sequence)
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(levels - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            packed = np.packbits(np.pad(bit, (0, 64 - len(bit) % 64)), bitorder="little").view(np.uint64)
            count = np.bitwise_count(packed).astype(np.int32)
            self.words.append(packed)
            self.before.append(np.cumsum(count, dtype=np.int32) - count)
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each symbol c and place i, the place its last level gives to i: the difference of two
        such places counts c between them."""
        at = at.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & below)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Index of a sequence of symbols; 0 ends a segment and matches nothing."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.depth = depth
        ranks = {1: text.astype(np.int64)}
        size = 1
        while size * 2 <= depth:
            ranks[size * 2] = self._joined(ranks[size], ranks[size], size)
            size *= 2
        self.rows = {}
        for wanted in (depth - 1, depth):
            rank, done = None, 0
            for part in sorted(ranks, reverse=True):
                if done + part <= wanted:
                    rank = ranks[part] if rank is None else self._joined(rank, ranks[part], done)
                    done += part
            self.rows[wanted] = rank
        # rows in order of their first depth words, then of place
        self.suffix = np.argsort(self.rows[depth], kind="stable")
        last = text[self.suffix - 1]  # the first suffix is preceded by the last segment's end
        self.levels = max(1, int(text.max(initial=0)).bit_length())
        self.tree = WaveletMatrix(last.astype(np.int64), self.levels)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))])
        symbols = np.arange(len(self.first) - 1)
        self.origin = self.tree.rank(symbols, np.zeros(len(symbols), np.int64))
        shorter = self.rows[depth - 1][self.suffix]
        new = np.ones(n + 1, bool)
        new[1:n] = shorter[1:] != shorter[:-1]
        starts = np.flatnonzero(new[:n])
        group = np.cumsum(new[:n]) - 1
        self.wide_low = starts[group]
        self.wide_high = np.append(starts[1:], n)[group]

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        """Ranks by ``a`` here and then ``b`` ``shift`` places on."""
        n = len(a)
        later = np.zeros(n, np.int64)
        later[: max(n - shift, 0)] = b[shift:] + 1
        return np.unique(a * (int(b.max(initial=0)) + 2) + later, return_inverse=True)[1].astype(np.int64)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with a symbol and then what the rows low to high begin with."""
        base = self.first[symbol] - self.origin[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that share depth - 1 words with row ``low``: a pattern of depth words without its last."""
        return self.wide_low[low], self.wide_high[low]


def window_rows(index: FMIndex, text: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each place of ``text`` that begins a window of ``depth`` words within its segment, the
    first row of the window's interval; -1 elsewhere. Segments end before ``ends``. All segments are
    streamed at once from right to left, each keeping the rows of its current match."""
    out = np.full(len(text), -1, np.int64)
    order = np.argsort(-lengths, kind="stable")
    ends, lengths = ends[order], lengths[order]
    low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(text), np.int64)
    for step in range(1, int(lengths.max(initial=0)) + 1):
        live = int(np.searchsorted(-lengths, -step, "right"))
        at = ends[:live] - step
        low, high = low[:live], high[:live]
        if step > index.depth:
            low, high = index.shorten(low)
        low, high = index.extend(text[at], low, high)
        if step >= index.depth:
            out[at] = low
    return out
