"""An FM-index over integer sequences, with vectorised backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the last symbol is the smallest
    and occurs once."""
    order = np.argsort(text, kind="stable")
    rank = np.empty(len(text), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], np.diff(text[order]) != 0)))
    step = 1
    while rank[order[-1]] < len(text) - 1:
        after = np.zeros(len(text), np.int64)
        after[:-step] = rank[step:] + 1
        pair = rank * (len(text) + 1) + after
        order = np.argsort(pair, kind="stable")
        rank[order] = np.cumsum(np.concatenate(([0], np.diff(pair[order]) != 0)))
        step *= 2
    return order


class WaveletMatrix:
    """Symbols as bit levels (top bit first), zeros moved before ones at each
    level; a level is packed words with running counts."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max()).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[:len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, end = np.zeros_like(at), at
        for k in range(self.levels):
            ones = symbol >> (self.levels - 1 - k) & 1 == 1
            a, b = self._ones(k, start), self._ones(k, end)
            start = np.where(ones, self.zeros[k] + a, start - a)
            end = np.where(ones, self.zeros[k] + b, end - b)
        return end - start

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & below).astype(np.int64)


class FMIndex:
    """Index of a text of dense symbols from 1 on (0 ends the text)."""

    def __init__(self, text: np.ndarray):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.tree = WaveletMatrix(text[order - 1])
        self.size = len(text)

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that begin with the
        symbol before those in [low, high)."""
        n = len(low)
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[:n], self.first[symbol] + both[n:]

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, limit: int, least: int = 2) -> np.ndarray:
        """For each place in ``ends`` how many symbols of ``text`` up to and
        including it occur at least ``least`` times, counted to ``limit``."""
        length = np.zeros(len(ends), np.int64)
        active = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for k in range(limit):
            low, high = self.extend(low, high, text[ends[active] - k])
            keep = high - low >= least
            active, low, high = active[keep], low[keep], high[keep]
            if not len(active):
                break
            length[active] = k + 1
        return length
