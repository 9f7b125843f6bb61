"""Wavelet matrix over a sequence of small class numbers, with rank queries on many positions at once.

Level by level, from the highest bit of the class down, the sequence is
partitioned stably into zeros and ones; each level keeps its bits in 64-bit
words with the count of ones before every word.  A prefix of the sequence maps
at every level to one interval for each class prefix, so the count of a set of
classes is the sum of the widths of the few intervals that cover the set:
whole subtrees are taken at once, without going down to single classes.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit sequence with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits, for an array of i."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    def __init__(self, classes: np.ndarray, bits: int):
        """``classes``: uint8 numbers below 2 ** bits."""
        self.bits = bits
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (classes >> level) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(len(bit) - int(bit.sum()))
            if level:
                classes = np.concatenate([classes[bit == 0], classes[bit == 1]])

    def count(self, i: np.ndarray, wanted: frozenset[int]) -> np.ndarray:
        """Members of ``wanted`` among the first i elements, for an array of positions i."""
        return self._count(np.asarray(i, np.int64), np.zeros(1, np.int64), 0, 0, wanted)

    def _count(self, end: np.ndarray, start: np.ndarray, level: int, prefix: int, wanted: frozenset[int]) -> np.ndarray:
        width = 1 << (self.bits - level)
        here = sum(prefix * width <= c < (prefix + 1) * width for c in wanted)
        if here == width:
            return end - start
        if not here:
            return np.zeros(len(end), np.int64)
        e, s = self.levels[level].ones(end), self.levels[level].ones(start)
        low = self._count(end - e, start - s, level + 1, 2 * prefix, wanted)
        return low + self._count(self.zeros[level] + e, self.zeros[level] + s, level + 1, 2 * prefix + 1, wanted)
