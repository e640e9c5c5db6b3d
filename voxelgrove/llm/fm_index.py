"""An FM-index over a sequence of small integers: Burrows-Wheeler transform, wavelet matrix for ranks, sampled suffix positions.

Everything works on arrays of patterns or rows at a time. Symbol 0 separates runs of text; patterns never contain it, and the first position of
each run is sampled, so locating never walks across a separator.
"""

from __future__ import annotations

import numpy as np

SAMPLED_EVERY = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling; each separator sorts as a symbol of its own, by position."""
    n = len(text)
    apart = text == 0
    rank = text.astype(np.int64) + np.count_nonzero(apart)
    rank[apart] = np.arange(np.count_nonzero(apart))
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    def __init__(self, text: np.ndarray):
        """``text`` ends with a separator and begins with a symbol."""
        n = self.n = len(text)
        order = suffix_order(text)
        self.bwt = text[order - 1]
        self.levels = max(1, int(text.max()).bit_length())
        counts = np.bincount(text, minlength=(1 << self.levels) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # rows of smaller symbols
        # Wavelet matrix: for each bit from the highest, the ones before each place, and the number of zeros.
        self.ones, self.zeros, symbols = [], [], self.bwt
        for level in range(self.levels):
            bit = (symbols >> (self.levels - 1 - level)) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        sampled = order % SAMPLED_EVERY == 0
        sampled |= text[order - 1] == 0
        self.sampled, self.samples = sampled, order[sampled]
        self.samples_before = np.concatenate([[0], np.cumsum(sampled)])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low = np.zeros_like(at)
        for level in range(self.levels):
            ones, one = self.ones[level], (symbol >> (self.levels - 1 - level)) & 1 == 1
            a, b = ones[at], ones[low]
            at = np.where(one, self.zeros[level] + a, at - a)
            low = np.where(one, self.zeros[level] + b, low - b)
        return at - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of patterns (rows of equal length): those that occur, and their rows of the index from and to."""
        known = np.flatnonzero((patterns < 1 << self.levels).all(axis=1))
        low, high = np.zeros(len(known), np.int64), np.full(len(known), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            c = patterns[known, j].astype(np.int64)
            low, high = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
            alive = low < high
            known, low, high = known[alive], low[alive], high[alive]
        return known, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the index, stepping back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        left, rows = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            hit = self.sampled[rows]
            out[left[hit]] = self.samples[self.samples_before[rows[hit]]] + steps
            left, rows = left[~hit], rows[~hit]
            c = self.bwt[rows].astype(np.int64)
            rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out
