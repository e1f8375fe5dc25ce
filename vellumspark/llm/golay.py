"""The perfect binary Golay code of length 23 as a fuzzy hash.

Every 23-bit word lies within distance 3 of exactly one codeword. A word at distance 3 of its codeword
also has five codewords at distance 4. With the indices of all of these as keys, any two words that
differ in two bits or fewer share a key.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, coefficients from x^11 down
LENGTH, CHECKS = 23, 11


def remainder(word: int) -> int:
    """The word's syndrome: its remainder modulo the generator polynomial."""
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, the error pattern of each syndrome, and the codewords to add for further keys."""
    one = np.array([remainder(1 << i) for i in range(LENGTH)], dtype=np.uint32)

    def sums(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << len(columns), dtype=np.uint32)
        for i, c in enumerate(columns):
            out[1 << i : 2 << i] = out[: 1 << i] ^ c
        return out

    low, high = sums(one[:12]), sums(one[12:])
    leader = np.zeros(1 << CHECKS, dtype=np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << b for b in bits)
            leader[low[word & 4095] ^ high[word >> 12]] = word
    messages = np.arange(1 << 12, dtype=np.uint32) << CHECKS
    codewords = messages | (low[messages & 4095] ^ high[messages >> 12])
    sevens = codewords[np.bitwise_count(codewords) == 7]
    more = np.zeros((1 << CHECKS, 6), dtype=np.uint32)
    for syndrome, error in enumerate(leader):
        if int(error).bit_count() == 3:
            more[syndrome, 1:] = sevens[(sevens & error) == error]
    return low, high, leader, more


def keys(words: np.ndarray) -> np.ndarray:
    """For each word six 12-bit codeword indices; words nearer than 3 to their codeword repeat one index."""
    low, high, leader, more = tables()
    words = words.astype(np.uint32)
    syndrome = low[words & 4095] ^ high[words >> 12]
    return ((words ^ leader[syndrome])[:, None] ^ more[syndrome]) >> CHECKS
