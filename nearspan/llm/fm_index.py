"""A compressed FM-index over words: suffix order by prefix doubling, the transform in a wavelet matrix of packed bits.

What is kept are the bits of the transform with a running count for each 64 of them, where each symbol begins in suffix
order, and running weights of the suffixes: a segment that the input has several times is indexed once, with its number.
Searches go backward and are done for many patterns at once, one numpy step for all.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Rank over symbols: one packed bit vector for each bit of a symbol, with a running count for each 64-bit word."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.words, self.sums, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(np.pad(bit.astype(np.uint8), (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def descend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the range [low, high) of each symbol's occurrences lies when the vector is sorted by reversed bits."""
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            words, sums, z = self.words[k], self.sums[k], self.zeros[k]
            both = []
            for at in (low, high):
                w = at >> 6
                r = sums[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
                both.append(np.where(one, z + r, at - r))
            low, high = both
        return low, high


class FMIndex:
    """Over segments of words, each given as 64-bit hashes; a match never runs over a segment's end."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, weights: np.ndarray | None = None):
        """words: all segments joined; starts: where each begins, and the end; weights: how often each occurs. Segments have 63 words at most."""
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        lengths, n = np.diff(starts), len(starts) - 1
        if n and lengths.max() > 63:
            raise ValueError("a segment is too long for six doublings")
        # A separator after each segment: all are symbol 0, but each sorts for itself, so 64 words settle every order.
        place = np.arange(len(words)) + np.repeat(np.arange(n), lengths)
        text = np.zeros(len(words) + n, np.int32)
        text[place] = ids + 1
        rank = text.astype(np.int64) + n - 1
        rank[starts[1:] + np.arange(n)] = np.arange(n)
        size = len(text)
        for k in (1, 2, 4, 8, 16, 32):
            after = np.zeros(size, np.int64)
            after[:-k] = rank[k:] + 1 if k < size else 0
            key = rank * (size + len(self.vocabulary) + n + 2) + after
            order = np.argsort(key)
            sorted_ = key[order]
            rank = np.empty(size, np.int64)
            rank[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
            if rank.max(initial=-1) == size - 1:
                break
        order = np.empty(size, np.int32)
        order[rank] = np.arange(size, dtype=np.int32)
        each = np.repeat(np.ones(n, np.int64) if weights is None else weights, lengths + 1)[order]
        each[text[order] == 0] = 0  # separators
        self.weight = np.concatenate([[0], np.cumsum(each)])
        sigma = len(self.vocabulary) + 1
        self.wavelet = Wavelet(text[order - 1], sigma)
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        every = np.arange(sigma)
        begin, _ = self.wavelet.descend(every, np.zeros(sigma, np.int64), np.zeros(sigma, np.int64))
        self.step = first[:sigma] - begin  # from a symbol's place in the wavelet's order to its rows of the suffix order
        self.first, self.ids = first, (ids + 1).astype(np.int32)

    def leftmost(self, pattern: np.ndarray, end: np.ndarray, stop: np.ndarray, least: int = 2) -> np.ndarray:
        """For patterns within an array of symbols: the smallest s >= stop such that pattern[s..end] occurs ``least`` times, weights counted; end + 1 if none."""
        out = end + 1
        lane = np.flatnonzero(end >= stop)
        at = end[lane].copy()
        low, high = self.first[pattern[at]], self.first[pattern[at] + 1]
        while True:
            some = self.weight[high] - self.weight[low] >= least
            lane, at, low, high = lane[some], at[some], low[some], high[some]
            out[lane] = at
            more = at > stop[lane]
            lane, at, low, high = lane[more], at[more] - 1, low[more], high[more]
            if not len(lane):
                return out
            symbol = pattern[at]
            low, high = self.wavelet.descend(symbol, low, high)
            low, high = low + self.step[symbol], high + self.step[symbol]


def repeated_windows(words: np.ndarray, starts: np.ndarray, anchor: np.ndarray, gram: int, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    """For segments all of whose windows of ``size`` words hold the gram at ``anchor``: bit k is set if window k occurs twice.

    anchor: place of the gram in each segment; weights: how often the input has each segment. Matching statistics around the gram bound the windows that can occur twice;
    what is between is settled from both sides.
    """
    n = len(starts) - 1
    if not n:
        return np.zeros(0, np.int64)
    index = FMIndex(words, starts, weights)
    text, begin = index.ids, starts[:-1].astype(np.int64)
    last = starts[1:].astype(np.int64) - 1
    a = begin + anchor
    u = index.leftmost(text, a + gram - 1, begin)
    # The gram's longest extension to the right, by bisection: pattern[a..e] occurs less often the longer it is.
    low, high = a - 1, last.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        lane = np.flatnonzero(open_)
        hit = index.leftmost(text, mid[lane], a[lane]) <= a[lane]
        low[lane[hit]] = mid[lane[hit]]
        high[lane[~hit]] = mid[lane[~hit]] - 1
    v = np.minimum(low, last) - size + 1
    mask = np.zeros(n, np.int64)

    def mark(lane: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        mask[lane] |= ((np.int64(1) << (hi - lo + 1)) - 1) << (lo - begin[lane])

    lane = np.flatnonzero(u <= v)
    while len(lane):
        r = index.leftmost(text, v[lane] + size - 1, u[lane])
        hit = r <= v[lane]
        mark(lane[hit], r[hit], v[lane[hit]])
        v[lane] = np.where(hit, r, v[lane]) - 1
        lane = lane[u[lane] <= v[lane]]
        r = index.leftmost(text, u[lane] + size - 1, u[lane])
        hit = r == u[lane]
        mark(lane[hit], u[lane[hit]], u[lane[hit]])
        u[lane] = np.where(hit, u[lane] + 1, r)
        lane = lane[u[lane] <= v[lane]]
    return mask
