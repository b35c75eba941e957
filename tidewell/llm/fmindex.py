"""FM-index over word symbols: suffix order, wavelet matrix, backward search, sampled positions.

Symbol 0 ends a run of words; every 0 counts as a terminator of its own, so
no phrase crosses one and equal runs are told apart where they end.
"""

from __future__ import annotations

import numpy as np

#: Up to this size three ranks fit one 63-bit sort key; a larger index sorts by two at first.
MAX_SYMBOLS = 2**21 - 2
_SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in lexicographic order (prefix doubling on unresolved groups)."""
    n = len(symbols)
    ends = symbols == 0
    total = int(ends.sum())
    first = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + total)
    padded = np.concatenate([first + 1, np.zeros(2, np.int64)])
    reach = 3 if int(padded.max(initial=0)) < 2**21 else 2
    key = (padded[:n] << 42) | (padded[1:n + 1] << 21) | padded[2:n + 2] if reach == 3 else (padded[:n] << 31) | padded[1:n + 1]
    order = np.argsort(key, kind="stable")
    fresh = np.empty(n, bool)
    if n:
        fresh[0] = True
        sorted_key = key[order]
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = head
    tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
    while len(tied):
        at = order[tied]
        nxt = rank[np.minimum(at + reach, n)]
        inner = np.lexsort((nxt, head[tied]))
        at, nxt, group = at[inner], nxt[inner], head[tied][inner]
        order[tied] = at
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        new = np.maximum.accumulate(np.where(fresh, tied, 0))
        head[tied] = new
        rank[at] = new
        keep = ~fresh | ~np.append(fresh[1:], True)
        tied = tied[keep]
        reach *= 2
    return order


class WaveletMatrix:
    """Rank and access over a sequence of small integers, bit by bit from the highest."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        n = len(values)
        for level in range(self.bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            self.words.append(packed)
            self.counts.append(before)
            self.zeros.append(n - int(before[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def descend(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix [0, at) ends in the last level, walking the bits of ``value``."""
        at = at.astype(np.int64)
        for i in range(self.bits):
            ones = self._ones(i, at)
            at = np.where((value >> (self.bits - 1 - i)) & 1, self.zeros[i] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, descended position) of the symbols at ``at``."""
        at = at.astype(np.int64)
        value = np.zeros(len(at), np.int64)
        for i in range(self.bits):
            bit = (self.words[i][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(i, at)
            value = (value << 1) | bit.astype(np.int64)
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
        return value, at


class FMIndex:
    """Counts and locates phrases of words in one shard."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        if not len(symbols) or symbols[-1]:
            symbols = np.append(symbols, 0)  # the empty suffix needs a row too
        n = len(symbols)
        order = suffix_order(symbols)
        before = np.where(order > 0, symbols[order - 1], 0).astype(np.int64)
        self.n = n
        self.tree = WaveletMatrix(before, top)
        counts = np.bincount(symbols, minlength=top + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.base = self.tree.descend(np.arange(top + 1), np.zeros(top + 1, np.int64))
        sampled = (order % _SAMPLE == 0) | (before == 0)
        self.marked = np.packbits(sampled, bitorder="little")
        rows = np.flatnonzero(sampled)
        self.sample_rows, self.sample_at = rows, order[rows]

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.descend(symbol, at) - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open suffix intervals of phrases (one a row), found from the last word back."""
        low = self.first[phrases[:, -1]].copy()
        high = self.first[phrases[:, -1] + 1].copy()
        live = np.flatnonzero(low < high)
        for column in range(phrases.shape[1] - 2, -1, -1):
            symbol = phrases[live, column]
            low[live], high[live] = self._step(symbol, low[live]), self._step(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the next sampled one."""
        rows = rows.copy()
        found = np.full(len(rows), -1, np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            now = rows[open_]
            hit = (self.marked[now >> 3] >> (now & 7).astype(np.uint8)) & 1 == 1
            done = open_[hit]
            found[done] = self.sample_at[np.searchsorted(self.sample_rows, rows[done])] + steps
            open_ = open_[~hit]
            if len(open_):
                symbol, down = self.tree.access(rows[open_])
                rows[open_] = self.first[symbol] + down - self.base[symbol]
            steps += 1
        return found
