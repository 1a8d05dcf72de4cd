"""FM-index over integer sequences: suffix array, wavelet-matrix ranks, backward search and location."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes. Several leading symbols are sorted at once, then prefix doubling works on the suffixes
    that still share a rank; a suffix that ends sorts before its extensions."""
    n = len(seq)
    width = max(1, int(seq.max(initial=0)).bit_length())
    span = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    padded = np.concatenate((seq.astype(np.int64), np.zeros(span, np.int64)))
    for k in range(span):
        key = (key << width) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = starts
    step = span
    while True:
        tied = ~first
        tied[:-1] |= ~first[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        sub = order[at]
        ahead = sub + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = (rank[sub] << 32) | second
        turn = np.argsort(pair, kind="stable")
        sub, pair = sub[turn], pair[turn]
        order[at] = sub
        fresh = np.ones(len(at), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        first[at] = fresh
        rank[sub] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        step *= 2


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit of the symbol per level."""

    def __init__(self, seq: np.ndarray, width: int):
        self.width = width
        self.zeros: list[np.ndarray] = []
        for level in range(width - 1, -1, -1):
            bit = (seq >> level) & 1
            before = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit == 0, out=before[1:])
            self.zeros.append(before)
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, *where: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each position."""
        low = np.zeros(len(symbol), np.int64)
        places = [low, *where]
        for k, before in enumerate(self.zeros):
            one = ((symbol >> (self.width - 1 - k)) & 1).astype(bool)
            nothing = before[-1]
            places = [np.where(one, nothing + p - (z := before[p]), z) for p in places]
        return [p - places[0] for p in places[1:]]


class FMIndex:
    """Index of a sequence of symbols >= 2; 1 separates parts, 0 is added as the end."""

    SAMPLE = 16

    def __init__(self, seq: np.ndarray, symbols: int):
        seq = np.append(seq, 0)
        order = suffix_array(seq)
        self.bwt = seq[order - 1]
        self.tree = WaveletMatrix(self.bwt, max(1, symbols.bit_length()))
        self.below = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=symbols + 1), out=self.below[1:])
        self.sampled = np.where(order % self.SAMPLE == 0, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns of one length, a row each, read from the last symbol to the first."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            a, b = self.tree.rank(c, low[alive], high[alive])
            low[alive], high[alive] = self.below[c] + a, self.below[c] + b
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back through the text until a sampled position is met."""
        rows = rows.copy()
        found = np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        steps = 0
        while len(open_):
            have = self.sampled[rows[open_]]
            done = have >= 0
            found[open_[done]] = have[done] + steps
            open_ = open_[~done]
            c = self.bwt[rows[open_]]
            rows[open_] = self.below[c] + self.tree.rank(c, rows[open_])[0]
            steps += 1
        return found
