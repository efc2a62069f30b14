"""An FM-index over a sequence of word numbers: suffix array, wavelet-matrix ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order of ``symbols`` by prefix doubling. Zeros separate runs: each is smaller than any word, and earlier ones
    are smaller than later ones, so no comparison crosses a separator. The last symbol has to be a zero."""
    n = len(symbols)
    breaks = symbols == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, symbols.astype(np.int64) + breaks.sum() - 1)
    order = np.argsort(rank, kind="stable")
    ordered = rank[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    h = 1
    open_slots = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(open_slots):
        members = order[open_slots]
        key = rank[members] * np.int64(n) + rank[members + h]
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[open_slots] = members
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[members] = open_slots[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        open_slots = open_slots[~(first & np.append(first[1:], True))]
        h *= 2
    return order


class WaveletMatrix:
    """Ranks and accesses over ``values``, each one step per bit of the alphabet and vectorised over the queries."""

    def __init__(self, values: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.zeros, self.ones_before = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones_before.append(before)
            self.zeros.append(len(values) - int(before[-1]))
            values = np.concatenate((values[~bit], values[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``."""
        low = np.zeros_like(at)
        for k in range(self.bits):
            ones, zero = self.ones_before[k], self.zeros[k]
            bit = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            at = np.where(bit, zero + ones[at], at - ones[at])
            low = np.where(bit, zero + ones[low], low - ones[low])
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for k in range(self.bits):
            ones, zero = self.ones_before[k], self.zeros[k]
            bit = (ones[at + 1] - ones[at]).astype(bool)
            symbol = symbol << 1 | bit
            at = np.where(bit, zero + ones[at], at - ones[at])
            low = np.where(bit, zero + ones[low], low - ones[low])
        return symbol, at - low


class FMIndex:
    """Index of ``symbols`` (0 separates, words are 1 to ``size`` - 1; the last symbol is 0)."""

    def __init__(self, symbols: np.ndarray, size: int, step: int = 16):
        symbols = symbols.astype(np.int64)
        order = suffix_array(symbols)
        previous = symbols[order - 1]  # of position 0: the last symbol, a separator
        self.tree = WaveletMatrix(previous, size)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size))))
        # every step-th position is kept, and the first of each run, so that no walk meets a separator
        self.kept = (order % step == 0) | (previous == 0)
        self.slot = np.cumsum(self.kept) - 1
        self.position = order[self.kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the phrases, rows of ``phrases`` that are filled to the right. Backward, a word at a time."""
        n = self.before[-1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (high > low))
            if not len(live):
                break
            word = phrases[live, lengths[live] - back]
            low[live] = self.before[word] + self.tree.rank(word, low[live])
            high[live] = self.before[word] + self.tree.rank(word, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walks back to a kept row, counting the steps."""
        rows = rows.copy()
        found, walked = np.zeros(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            done = self.kept[rows[live]]
            ended = live[done]
            found[ended] = self.position[self.slot[rows[ended]]] + walked
            live = live[~done]
            symbol, rank = self.tree.access(rows[live])
            rows[live] = self.before[symbol] + rank
            walked += 1
        return found
