"""A compressed full-text index over sequences of words: Burrows-Wheeler transform in a wavelet matrix.

All operations take arrays of queries, so a step of backward search costs a few array operations however
many queries advance together. Suffixes are sorted by their first DEPTH words, which decides every
interval of a pattern of at most DEPTH words.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of text in the order of the DEPTH words that begin there; ties in any order."""
    n = len(text)
    rank = text.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    span = 1
    while span < DEPTH:
        key = rank * (n + int(text.max(initial=0)) + 2)
        key[: n - span] += rank[span:]
        order = np.argsort(key, kind="stable")
        steps = np.empty(n, np.int64)
        steps[0:1] = 1
        sorted_ = key[order]
        steps[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(steps)
        span *= 2
        if n and rank[order[-1]] == n:
            break
    return order


class WaveletMatrix:
    """Bit vectors of the symbols' bits from high to low, each sorted by the bit before it, with counts for every 64 bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, (size - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(int(len(symbols) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        #: Where each symbol's occurrences begin after the last level.
        self.starts = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & mask)
            at = np.where(one == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.starts[symbol]


class FMIndex:
    """Index over text, whose symbols are 0 (matches nothing) to size - 1; each position has an owner.

    ``least_owner`` gives the least owner among the occurrences in an interval.
    """

    def __init__(self, text: np.ndarray, size: int, owner: np.ndarray):
        order = suffix_order(text)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)
        self.least = [owner[order].astype(np.int32)]
        width = 1
        while 2 * width <= self.n:
            before = self.least[-1]
            self.least.append(np.minimum(before[: len(before) - width], before[width:]))
            width *= 2

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with the symbol put before them."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.first[symbol] + both[: len(symbol)], self.first[symbol] + both[len(symbol) :]

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), np.int64)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << int(k))])
        return out


def matched_windows(index: FMIndex, text: np.ndarray, start: np.ndarray, windows: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of width words that have an occurrence with a lesser owner: enough of them to cover all that are covered.

    Query q has windows[q] windows, the first at start[q] of text. A window is searched from its last word back; where
    its suffix from word p on stops matching, no window that contains this suffix can match, and the search goes on
    behind p. So text without matches costs a few steps for each width of it. After a match the next window that would
    continue it without overlap is tried; if it fails, the last match that reaches into it is found by halving.
    """
    n = len(start)
    at, last, top, resume = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    mode = np.zeros(n, np.int8)  # 0 going on, 1 halving, 2 one by one
    depth = np.zeros(n, np.int64)
    lo, hi = np.zeros(n, np.int64), np.full(n, index.n, np.int64)
    live = np.flatnonzero(windows > 0)
    found_q, found_at = [], []
    while len(live):
        symbol = text[start[live] + at[live] + width - 1 - depth[live]]
        lo[live], hi[live] = index.extend(symbol, lo[live], hi[live])
        going = np.zeros(len(live), bool)
        some = np.flatnonzero(hi[live] > lo[live])
        going[some] = index.least_owner(lo[live[some]], hi[live[some]]) < owner[live[some]]
        depth[live[going]] += 1

        hit = live[going & (depth[live] == width)]
        if len(hit):
            found_q.append(hit)
            found_at.append(at[hit].copy())
            last[hit] = at[hit]
            m = mode[hit]
            plain, half, single = hit[m == 0], hit[m == 1], hit[m == 2]
            done = at[plain] == windows[plain] - 1
            at[plain] = np.where(done, windows[plain], np.minimum(at[plain] + width, windows[plain] - 1))
            _halve(half, at, last, top, resume, mode)
            at[single] += 1
            _end_single(single, at, last, top, resume, mode)
        miss = live[~going]
        if len(miss):
            behind = at[miss] + width - depth[miss]
            m = mode[miss]
            plain, p = miss[m == 0], behind[m == 0]
            reach = (last[plain] >= 0) & (at[plain] - last[plain] > 1)
            enter = plain[reach]
            top[enter], resume[enter], mode[enter] = at[enter], p[reach], 1
            at[enter] = (last[enter] + top[enter]) // 2
            on = plain[~reach]
            at[on], last[on] = p[~reach], -1
            half, p = miss[m == 1], behind[m == 1]
            closed = p >= top[half]
            less = half[closed]
            top[less] = at[less]
            _halve(less, at, last, top, resume, mode)
            rest = half[~closed]  # windows further on are still open: all in turn
            mode[rest] = 2
            at[rest] = last[rest] + 1
            single = miss[m == 2]
            at[single] = behind[m == 2]
            _end_single(single, at, last, top, resume, mode)
        new = live[~going | (depth[live] == width)]
        depth[new], lo[new], hi[new] = 0, 0, index.n
        live = live[at[live] < windows[live]]
    none = np.zeros(0, np.int64)
    return np.concatenate([*found_q, none]), np.concatenate([*found_at, none])


def _halve(q, at, last, top, resume, mode) -> None:
    more = top[q] - last[q] > 1
    at[q[more]] = (last[q[more]] + top[q[more]]) // 2
    done = q[~more]
    at[done], mode[done], last[done] = resume[done], 0, -1


def _end_single(q, at, last, top, resume, mode) -> None:
    done = q[at[q] >= top[q]]
    at[done], mode[done], last[done] = np.maximum(at[done], resume[done]), 0, -1
