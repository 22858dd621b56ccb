"""An FM-index over a sequence of small integers: suffix order, wavelet matrix, backward search and sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order, by prefix doubling; the last symbol must be the only smallest one."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(step):
        key <<= bits
        if j < n:
            key[: n - j] |= text[j:]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        ordered = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        if step < n:
            key[: n - step] += rank[step:] + 1
        step *= 2


class WaveletMatrix:
    """Bit planes, the highest first, each with the count of zeros before every place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.counts = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(1 - bit, out=before[1:])
            self.counts.append(before)
            self.zeros.append(int(before[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where ``place`` ends up in the last plane on the path of ``symbol``."""
        for k in range(self.bits):
            low = self.counts[k][place]
            place = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + place - low, low)
        return place

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``place`` and where they end up in the last plane."""
        symbol = np.zeros(len(place), np.int64)
        for k in range(self.bits):
            low = self.counts[k][place]
            one = self.counts[k][place + 1] == low
            symbol = symbol * 2 + one
            place = np.where(one, self.zeros[k] + place - low, low)
        return symbol, place


class FMIndex:
    """Built over ``text`` of integers from 1 to ``sigma``; 0 stands for breaks and never matches."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.concatenate([text.astype(np.int64) + 1, [0]])  # the end is the only smallest symbol
        order = suffix_order(text)
        self.n = len(text)
        bits = max(1, int(sigma + 1).bit_length())
        self.wavelet = WaveletMatrix(text[order - 1], bits)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 2))])
        every = np.arange(sigma + 2)
        self.origin = self.wavelet.down(every, np.zeros(len(every), np.int64))
        self.marked = order % self.SAMPLE == 0
        self.rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.places = order[self.marked]

    def _before(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.smaller[symbol] + self.wavelet.down(symbol, row) - self.origin[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each phrase; ``phrases`` is one row each, padded on the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = live[low[live] < high[live]]
            now = live[lengths[live] > j]
            if not now.size:
                continue
            symbol = phrases[now, j] + 1
            low[now], high[now] = self._before(symbol, low[now]), self._before(symbol, high[now])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back until a sampled position."""
        out, steps, todo, row = np.full(len(rows), -1, np.int64), 0, np.arange(len(rows)), rows.copy()
        while todo.size:
            hit = self.marked[row]
            out[todo[hit]] = self.places[self.rank[row[hit]]] + steps
            todo, row = todo[~hit], row[~hit]
            if todo.size:
                symbol, place = self.wavelet.access(row)
                row = self.smaller[symbol] + place - self.origin[symbol]
                steps += 1
        return out
