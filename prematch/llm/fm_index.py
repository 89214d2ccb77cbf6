"""A compressed self-index of a sequence of word numbers, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with counts per 64 bits; rank is one lookup and one population count."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]))
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


class Wavelet:
    """A wavelet matrix: how often a number stands before a place."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for shift in range(max(int(top).bit_length(), 1) - 1, -1, -1):
            bit = (values >> shift & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bit)))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for shift, bits in self.levels:
            one = (value >> shift & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, bits.zeros + a, start - a), np.where(one, bits.zeros + b, i - b)
        return i - start


class FmIndex:
    """Index of ``text`` (numbers from 1; 0 parts passages) for patterns of up to ``depth`` numbers.

    Suffixes are sorted by doubling ranks. The Burrows-Wheeler transform is kept as a wavelet matrix. ``low`` and ``high``
    give, for a place in suffix order, the interval of the suffixes with the same first ``depth`` numbers.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.n, self.top = len(text), int(text.max(initial=0))
        def longer(rank: np.ndarray, step: int) -> np.ndarray:
            after = np.concatenate((rank[step:], np.zeros(min(step, len(rank)), np.int64)))
            return np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1] + 1

        at, rank, deep = 1, text.astype(np.int64), None
        while deep is None or rank.max(initial=0) < len(rank):
            if deep is None and 2 * at >= depth:
                deep = longer(rank, depth - at)  # equal for suffixes with the same first depth numbers
            rank, at = longer(rank, at), 2 * at
        self.order = np.argsort(rank)
        by = deep[self.order]
        first = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(by) else np.zeros(0, np.int64)
        self.groups = first
        which = np.cumsum(np.concatenate(([0], (by[1:] != by[:-1]).astype(np.int64)))) if len(by) else np.zeros(0, np.int64)
        self.low = first[which]
        self.high = np.concatenate((first[1:], [len(by)]))[which]
        self.which = which
        self.bwt = Wavelet(text[self.order - 1].astype(np.int64), self.top)
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.top + 1))))

    def extend(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each pattern with a number put before it."""
        base = self.counts[number]
        return base + self.bwt.rank(number, low), base + self.bwt.rank(number, high)

    def windows(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int):
        """Yield (passage, offset, place) for every window of depth numbers in the passages of ``text``: place is one in its interval.

        All passages are streamed together, from their ends: each step puts one number before every pattern, and a
        pattern longer than depth is widened to the interval of its first depth numbers. An empty interval starts anew.
        """
        live = np.flatnonzero(lengths >= depth)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        matched = np.zeros(len(live), np.int64)
        at = lengths[live] - 1
        while len(live):
            number = text[starts[live] + at]
            known = number <= self.top
            new_low, new_high = self.extend(np.where(known, number, 0), low, high)
            found = known & (new_low < new_high)
            low, high = np.where(found, new_low, 0), np.where(found, new_high, self.n)
            matched = np.where(found, matched + 1, 0)
            full = matched >= depth
            if full.any():
                place = np.where(full, low, 0)
                low, high = np.where(full, self.low[place], low), np.where(full, self.high[np.where(full, high - 1, 0)], high)
                yield live[full], at[full], low[full]
            more = at > 0
            live, low, high, matched, at = live[more], low[more], high[more], matched[more], at[more] - 1
