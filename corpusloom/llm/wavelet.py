"""A wavelet matrix over small symbols: how often a symbol occurs before a position, for many positions at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector that counts its ones before any position: packed words with running sums of their ones."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.before = np.cumsum(ones, dtype=np.int64) - ones

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """One bit vector a level, highest bit first; symbols are stably parted by each level's bit, zeros in front."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in reversed(range(levels)):
            bits = (symbols >> level & 1).astype(bool)
            kept = Bits(bits)
            zeros = len(symbols) - int(np.count_nonzero(bits))
            self.levels.append((level, kept, zeros))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol before each position."""
        first, at = np.zeros(1, np.int64), np.asarray(at, dtype=np.int64)
        for level, bits, zeros in self.levels:
            if symbol >> level & 1:
                first, at = bits.ones(first) + zeros, bits.ones(at) + zeros
            else:
                first, at = first - bits.ones(first), at - bits.ones(at)
        return at - first
