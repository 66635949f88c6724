"""The binary Golay code (23, 12): every word is within 3 bits of one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

# Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BITS = 23
CHECKS = 11


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


class Golay:
    """All codewords within 4 bits of a word, by the remainder of the word.

    That is one codeword for words within 2 bits of theirs, and six for the rest.
    Two words that differ in at most 2 bits have such a codeword in common: the
    one nearest to a word halfway between them.
    """

    def __init__(self) -> None:
        one = [_remainder(1 << bit) for bit in range(BITS)]
        errors: dict[int, list[int]] = {0: [0]}
        for n in range(1, 5):
            for bits in combinations(range(BITS), n):
                left = 0
                for bit in bits:
                    left ^= one[bit]
                errors.setdefault(left, []).append(sum(1 << bit for bit in bits))
        most = max(map(len, errors.values()))
        self.errors = np.array([errors[k] + [-1] * (most - len(errors[k])) for k in range(1 << CHECKS)], np.int64)
        byte = np.zeros((3, 256), np.int64)
        for k in range(BITS):
            byte[k // 8] ^= np.where(np.arange(256) >> k % 8 & 1, one[k], 0)
        self.byte = byte

    def near(self, words: np.ndarray) -> np.ndarray:
        """Numbers (12 bits) of the codewords within 4 bits, a row for each word; -1: no more."""
        left = self.byte[0][words & 255] ^ self.byte[1][words >> 8 & 255] ^ self.byte[2][words >> 16]
        errors = self.errors[left]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)
