"""A compressed FM-index over words, searched for many queries in lockstep.

The index of a shard holds the Burrows-Wheeler transform as a wavelet matrix (bit vectors with block counts), the
start of each word's suffixes, the owner of each suffix and the borders of suffix classes that agree in ``size - 1`` words.
Segments end in terminators that no query has, so no match runs over a segment's end.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of a symbol in a prefix, for arrays of questions at once."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(int(symbols - 1).bit_length(), 1)
        self.size = len(values)
        self.words, self.counts, self.zeros = [], [], []
        current = values
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed))[:-1])).astype(np.int32))
            ones = bit.astype(bool)
            zeros = current[~ones]
            self.zeros.append(len(zeros))
            current = np.concatenate((zeros, current[ones]))
        order = np.zeros(symbols, np.int64)  # where each symbol begins at the bottom
        edge = np.flatnonzero(np.concatenate(([True], current[1:] != current[:-1]))) if len(current) else np.zeros(0, np.int64)
        order[current[edge]] = edge
        self.first = order

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] is in the first at[i] values. Symbols that never occur give nonsense."""
        place = at.astype(np.int64)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            block = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & mask)
            place = np.where((symbol >> level) & 1, self.zeros[k] + ones, place - ones)
        return place - self.first[symbol]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Suffix array by doubling; and the ranks of the largest power of two of words, up to ``depth``, with that power."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    kept, power, span = None, 0, 1
    while True:
        if span <= depth:
            kept, power = rank, span
        following = np.zeros(n, np.int64)
        following[: max(n - span, 0)] = rank[span:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        changed = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = changed
        span *= 2
        if changed[-1] == n - 1:
            return order, kept, power


class FMIndex:
    """``segments`` are arrays of word ids from 1, each with an owner; ``size`` is the match length that counts."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray, size: int):
        self.size, count = size, len(segments)
        lengths = np.fromiter(map(len, segments), np.int64, count)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner] = np.concatenate(segments)
        unique = text + count
        unique[ends] = np.arange(count)  # each terminator differs from the others, and all sort before words
        order, rank, power = suffix_order(unique, size - 1)
        n = len(text)
        self.n, self.symbols = n, int(text.max()) + 1
        self.tree = WaveletMatrix(text[order - 1], self.symbols)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.symbols))))
        self.owner = np.repeat(owners, lengths + 1)[order]
        # Neighbours agree in size - 1 words if their first ``power`` words do and those from size - 1 - power on.
        shift = size - 1 - power
        pad = np.concatenate((rank, -1 - np.arange(shift + 1)))
        a, b = order[:-1], order[1:]
        same = (rank[a] == rank[b]) & (pad[a + shift] == pad[b + shift])
        self.borders = np.concatenate(([0], np.flatnonzero(~same) + 1, [n]))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of (symbol + what the intervals stand for): one backward step for each."""
        known = (symbol > 0) & (symbol < self.symbols)
        safe = np.where(known, symbol, 1 if self.symbols > 1 else 0)
        both = self.tree.rank(np.concatenate((safe, safe)), np.concatenate((low, high)))
        begin = self.starts[safe]
        m = len(symbol)
        low, high = begin + both[:m], np.minimum(begin + both[m:], self.starts[safe + 1])
        return low, np.where(known, high, low)

    def windows(self, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, offsets): the suffix interval of each run of ``size`` words of each query, in order; empty where
        it does not occur. Query i's are offsets[i]:offsets[i + 1].

        The matching statistics, cut at ``size``: each query keeps the interval of the longest match to the right of its
        place, of at most size - 1 words. A word that can't be put before it shortens the match by its last word.
        """
        size = self.size
        lengths = np.fromiter(map(len, queries), np.int64, len(queries))
        base = np.concatenate(([0], np.cumsum(lengths)))
        words = np.concatenate([*queries, np.zeros(0, np.int64)])
        offsets = np.concatenate(([0], np.cumsum(np.maximum(lengths - size + 1, 0))))
        out_low, out_high = np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1], np.int64)
        q = np.flatnonzero(lengths >= size)
        end, at = lengths[q].copy(), lengths[q] - 1  # the match is of words at + 1:end
        low, high = np.zeros(len(q), np.int64), np.full(len(q), self.n)
        while len(q):
            new_low, new_high = self.extend(words[base[q] + at], low, high)
            good = new_high > new_low
            full = good & (end - at == size)
            if full.any():
                place = offsets[q[full]] + at[full]
                out_low[place], out_high[place] = new_low[full], new_high[full]
                group = np.searchsorted(self.borders, new_low[full], "right")
                new_low[full], new_high[full] = self.borders[group - 1], self.borders[group]
            low, high = np.where(good, new_low, 0), np.where(good, new_high, self.n)
            end = np.where(full | ~good, end - 1, end)
            at = np.where(good, at - 1, end - 1)
            on = (at >= 0) & (end >= size)
            q, end, at, low, high = q[on], end[on], at[on], low[on], high[on]
        return out_low, out_high, offsets

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner of the suffixes in each interval; the largest integer for an empty one."""
        none = np.iinfo(np.int64).max
        found = np.full(len(low), none)
        on = high > low
        begin, inverse = np.unique(low[on], return_inverse=True)
        if len(begin):
            end = np.zeros(len(begin), np.int64)
            end[inverse] = high[on]
            cuts = np.stack((begin, end), 1).ravel()
            found[on] = np.minimum.reduceat(np.append(self.owner, none), cuts)[::2][inverse]
        return found
