"""A compressed full-text index: the Burrows-Wheeler transform of many sequences in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks in a sequence of numbers: a packed bit vector with running counts for each binary digit."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.digits = max(1, int(largest).bit_length())
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = symbols.astype(np.uint32)
        for d in reversed(range(self.digits)):
            bit = ((s >> np.uint32(d)) & np.uint32(1)).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)].astype(np.uint32))
            one = bit.astype(bool)
            self.zeros.append(len(s) - int(one.sum()))
            s = np.concatenate([s[~one], s[one]])
        self.starts = self._walk(np.arange(largest + 1), np.zeros(largest + 1, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.uint64)
        symbols = symbols.astype(np.uint64)
        for level, (words, before, zeros) in enumerate(zip(self.words, self.before, self.zeros)):
            word = (at >> np.uint64(6)).astype(np.intp)
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & np.uint64(63))) - np.uint64(1)))
            bit = (symbols >> np.uint64(self.digits - 1 - level)) & np.uint64(1)
            at = np.where(bit == 1, ones + np.uint64(zeros), at - ones)
        return at.astype(np.int64)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._walk(symbols, at) - self.starts[symbols]


class FMIndex:
    """Index of the sequences of a text: symbols from 1 on, and 0 after each sequence.

    Suffixes are sorted up to the end of their sequence or ``depth`` symbols, by doubling; lcp[r] is how many symbols rows r - 1
    and r share, capped at ``depth``. The transform lies in a wavelet matrix, and minima of lcp over powers of two lead from
    an interval of rows to the one of a shorter match.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n, ends = len(text), np.flatnonzero(text == 0)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))  # ends differ from one another, so no match crosses one
        ranks, width = [], 1
        while True:
            order = np.argsort(rank)
            new = np.r_[False, rank[order[1:]] != rank[order[:-1]]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            ranks.append(rank)
            if width >= depth or rank[order[-1]] == n - 1:
                break
            rank = rank * (n + 1) + np.r_[rank[width:] + 1, np.zeros(min(width, n), np.int64)]
            width *= 2
        lcp, a, b = np.zeros(n + 1, np.int64), order[:-1].copy(), order[1:].copy()
        for level in reversed(range(len(ranks))):
            same = np.flatnonzero((a < n) & (b < n))
            same = same[ranks[level][a[same]] == ranks[level][b[same]]]
            for x in (a, b):
                x[same] += 1 << level
            lcp[same + 1] += 1 << level
        self.n, self.largest = n, int(text.max(initial=0))
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=self.largest + 1))]
        self.matrix = WaveletMatrix(text[order - 1], self.largest)  # before the first place stands an end, the last
        self.least = [np.minimum(lcp, depth).astype(np.int16)]
        while (1 << len(self.least)) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def backward(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with a symbol and then what rows low to high begin with."""
        at = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return self.first[symbols] + at[: len(symbols)], self.first[symbols] + at[len(symbols) :]

    def shorter(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high) of the longest beginning of these rows that more rows share."""
        lcp = self.least[0]
        length = np.maximum(lcp[low], lcp[high])
        low, high = low.copy(), high.copy()
        for k in reversed(range(len(self.least))):
            least, step = self.least[k], 1 << k
            fits = low >= step  # rows low - step + 1 .. low all share it with the one before
            wide = np.flatnonzero(fits)
            low[wide[least[low[wide] - step + 1] >= length[wide]]] -= step
            wide = np.flatnonzero(high + step <= self.n)
            high[wide[least[high[wide]] >= length[wide]]] += step
        all_rows = length == 0
        low[all_rows], high[all_rows] = 0, self.n
        return length.astype(np.int64), low, high

    def matching_statistics(self, text: np.ndarray, start: np.ndarray, stop: np.ndarray, least: int = 2) -> np.ndarray:
        """For each place from start to stop of each streamed piece of a text, one piece after the other, the length of the longest match from there, up to stop, that occurs ``least`` times in the index.

        Pieces are read backwards, all at once: a match grows by the symbol before it by backward search; where the grown one
        is too rare, the match is shortened at its end and tried again. Symbols below 1 match nothing.
        """
        size = stop - start
        found, offset = np.zeros(int(size.sum()), np.int64), np.cumsum(size) - size - start
        at = stop - 1
        low, high, length = np.zeros(len(at), np.int64), np.full(len(at), self.n), np.zeros(len(at), np.int64)
        live = np.flatnonzero(at >= start)
        while len(live):
            symbol = text[at[live]]
            known = (symbol > 0) & (symbol <= self.largest)
            new_low, new_high = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            new_low[known], new_high[known] = self.backward(symbol[known], low[live[known]], high[live[known]])
            grows = new_high - new_low >= least
            up = live[grows]
            low[up], high[up] = new_low[grows], new_high[grows]
            length[up] += 1
            found[offset[up] + at[up]] = length[up]
            at[up] -= 1
            rare = live[~grows]
            none = rare[length[rare] == 0]
            at[none] -= 1
            cut = rare[length[rare] > 0]
            if len(cut):
                length[cut], low[cut], high[cut] = self.shorter(low[cut], high[cut])
            live = live[at[live] >= start[live]]
        return found
