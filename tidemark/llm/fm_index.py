"""An FM-index over word numbers: wavelet matrix ranks, backward search of many phrases at once, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols`` (non-negative ints, the last one unique), by prefix doubling."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length()) if n else 1
    span = max(1, 62 // bits)
    key, padded = np.zeros(n, np.int64), np.concatenate([symbols.astype(np.int64), np.zeros(span, np.int64)])
    for k in range(span):
        key = (key << bits) | padded[k : k + n]
    rank = np.empty(n, np.int64)
    while n:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        follow = np.full(n, 0, np.int64)
        follow[: max(0, n - span)] = rank[span:] + 1
        key = rank * (n + 1) + follow
        span *= 2
    return np.empty(0, np.int64)


class WaveletMatrix:
    """Ranks of symbols below 2 ** levels, one bit a level, highest bit first."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.ones, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(symbols) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(at)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, bit = self.ones[k], ((symbol >> level) & 1).astype(bool)
            start = np.where(bit, self.zeros[k] + ones[start], start - ones[start])
            at = np.where(bit, self.zeros[k] + ones[at], at - ones[at])
        return at - start


class FMIndex:
    """Index of runs of symbols 1 .. n_symbols, each run closed by a separator of its own.

    Separators are told apart in the suffix order, so that no match crosses one, and share the
    symbol 0 afterwards.  Every ``step``-th place of a run, its first one included, is sampled:
    a walk back from any place meets a sample before it leaves the run.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, step: int = 8) -> None:
        separator = text == 0
        n_separators = int(separator.sum())
        told_apart = text.astype(np.int64) + n_separators - 1
        told_apart[separator] = np.arange(n_separators)
        order = suffix_array(told_apart)
        self.bwt = text[order - 1].astype(np.int64)
        self.waves = WaveletMatrix(self.bwt, max(1, int(n_symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        first = np.concatenate([[True], separator[:-1]]) if len(text) else separator
        starts = np.flatnonzero(first)
        depth = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
        sampled = (depth % step == 0) | separator
        self.sample = np.where(sampled[order], order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of all rows of ``phrases`` (equal lengths), from the last word to the first."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.bwt), np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.before[symbol] + self.waves.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.waves.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled position and add the steps."""
        at, found, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            known = self.sample[at[open_]]
            done = known >= 0
            found[open_[done]] = known[done] + steps
            open_ = open_[~done]
            symbol = self.bwt[at[open_]]
            at[open_] = self.before[symbol] + self.waves.rank(symbol, at[open_])
            steps += 1
        return found
