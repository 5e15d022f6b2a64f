"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash of 23-bit words.

Every word is within three errors of exactly one codeword; its 12 information bits are the word's index. Words that
differ in one bit have one index in common if the word with three errors also lists the codewords at distance four:
there are five of them. So a word gives one or six keys, and its own index alone meets those of all its neighbours.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, INFO = 23, 12
#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, highest power first.
GENERATOR = 0b101011100011


def syndrome(word: int) -> int:
    """The remainder of a word, taken as a polynomial, by the generator."""
    for bit in range(BITS - 1, BITS - INFO - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (BITS - INFO))
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each bit; by syndrome: keys given (1 or 6), and the error patterns that lead to their codewords."""
    of_bit = np.array([syndrome(1 << b) for b in range(BITS)], np.int64)
    n = 1 << (BITS - INFO)
    count, errors = np.zeros(n, np.int64), np.zeros((n, 6), np.int64)
    for weight in range(5):
        for bits in combinations(range(BITS), weight):
            s = int(np.bitwise_xor.reduce(of_bit[list(bits)])) if bits else 0
            if weight < 4 or count[s] and bin(errors[s, 0]).count("1") == 3:
                errors[s, count[s]] = sum(1 << b for b in bits)
                count[s] += 1
    return of_bit, count, errors


@cache
def _halves() -> tuple[np.ndarray, np.ndarray]:
    of_bit = tables()[0]
    low, high = (np.zeros(1 << 12, np.int64) for _ in range(2))
    for b in range(12):
        on = np.arange(1 << 12) >> b & 1 == 1
        low[on] ^= of_bit[b]
        if b + 12 < BITS:
            high[on] ^= of_bit[b + 12]
    return low, high


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, indices): all keys of each 23-bit word, its own index first."""
    _, count, errors = tables()
    low, high = _halves()
    s = low[words & 0xFFF] ^ high[words >> 12]
    rows = np.repeat(np.arange(len(words)), count[s])
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(count[s]) - count[s], count[s])
    return rows, (words[rows] ^ errors[s[rows], nth]) >> (BITS - INFO)


def indices(words: np.ndarray) -> np.ndarray:
    """The index of each word's own codeword."""
    low, high = _halves()
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words ^ tables()[2][s, 0]) >> (BITS - INFO)
