"""The binary Golay code (23, 12): every 23-bit word is within 3 bits of exactly one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, CHECKS = 23, 11
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for i in range(BITS - 1, CHECKS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECKS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = [_remainder(1 << i) for i in range(BITS)]
    low = np.zeros(1 << 12, np.uint32)
    high = np.zeros(1 << 11, np.uint32)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ one[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ one[12 + i]
    error = np.zeros(1 << CHECKS, np.uint32)
    for n in range(4):
        for bits in combinations(range(BITS), n):
            syndrome = 0
            for i in bits:
                syndrome ^= one[i]
            error[syndrome] = sum(1 << i for i in bits)
    return low, high, error


LOW, HIGH, ERROR = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of each 23-bit word's codeword."""
    words = words.astype(np.uint32)
    return (words ^ ERROR[LOW[words & 0xFFF] ^ HIGH[words >> 12]]) >> CHECKS


FLIPS = np.array([0, *(1 << i for i in range(BITS))], np.uint32)


def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the codeword indexes of every word within one bit of words[row], each once."""
    found = np.sort(decode(words.astype(np.uint32)[:, None] ^ FLIPS[None, :]), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, at = np.nonzero(first)
    return rows, found[rows, at]
