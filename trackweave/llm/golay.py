"""Fuzzy hashing by the perfect Golay code (23, 12, 7).

A 23-bit word is the key of every codeword within distance four of it: the
word that it decodes to, and five more where that one is three away.  Any two
words that differ in at most two bits have a key in common (tests try all).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, CHECKS = 23, 11
# Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of each word, a polynomial over GF(2), by GENERATOR."""
    rest = np.asarray(words, np.int64).copy()
    for bit in range(BITS - 1, CHECKS - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - CHECKS), 0)
    return rest


def _errors() -> np.ndarray:
    """For each syndrome the error patterns of up to four bits, padded with -1."""
    table = np.full((1 << CHECKS, 6), -1, np.int64)
    used = np.zeros(1 << CHECKS, np.int64)
    for weight in range(5):
        flips = np.array([sum(1 << b for b in c) for c in combinations(range(BITS), weight)], np.int64)
        for e, s in zip(flips.tolist(), syndromes(flips).tolist()):
            table[s, used[s]] = e
            used[s] += 1
    return table


_TABLE: list[np.ndarray] = []


def keys(words: np.ndarray) -> np.ndarray:
    """Codeword indices (12 bits) near each word: n x 6, -1 where there are fewer."""
    if not _TABLE:
        _TABLE.append(_errors())
    words = np.asarray(words, np.int64)
    errors = _TABLE[0][syndromes(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)
