"""Bitvectors with rank and select: bits packed to words, counts of ones before each block of words."""

from __future__ import annotations

import numpy as np

#: Words of 64 bits of a block.
BLOCK = 8


class Bits:
    """A packed bitvector over bool flags; total is the number of ones.

    A directory holds the ones before each block. rank adds to it the ones of the block's words before the
    place, select finds the block in it by bisection, then the word, then the bit. Both take arrays.
    """

    def __init__(self, flags: np.ndarray):
        self.size = len(flags)
        blocks = self.size // (64 * BLOCK) + 1
        packed = np.zeros(blocks * BLOCK * 8, dtype=np.uint8)
        some = np.packbits(flags, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).reshape(blocks, BLOCK).astype(np.int64)
        self.inside = np.cumsum(ones, axis=1) - ones
        self.before = np.concatenate([[0], np.cumsum(ones.sum(axis=1))])
        self.total = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before the places at, each from 0 to size."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word // BLOCK] + self.inside[word // BLOCK, word % BLOCK] + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Places of the ones number k, each from 1 to total."""
        block = np.searchsorted(self.before, k, side="left") - 1
        left = k - self.before[block]
        word = (self.inside[block] < left[:, None]).sum(axis=1) - 1
        left = left - self.inside[block, word]
        at = block * BLOCK + word
        bits = np.unpackbits(self.words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(k) else np.zeros((0, 64), dtype=np.uint8)
        bit = (np.cumsum(bits, axis=1) < left[:, None]).sum(axis=1)
        return at * 64 + bit
