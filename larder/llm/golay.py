"""The perfect binary Golay code (23, 12, 7), for keys of 23-bit segments.

Every segment lies within 3 bits of exactly one codeword. The keys of a segment are
the indices (the 12 data bits) of all codewords within 4 bits: one key if the nearest
codeword is nearer than 3, six otherwise. Two segments that differ in one bit share a
key: the codeword nearest to one lies within 3 + 1 bits of the other.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def remainder(word: int) -> int:
    """word modulo the generator: zero for codewords, else what tells the error pattern."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 23 single bits; for each remainder up to 6 error patterns of 4 bits at most (-1: none)."""
    single = np.array([remainder(1 << i) for i in range(23)], np.int64)
    patterns = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= int(single[b])
            patterns[s, used[s]] = sum(1 << b for b in bits)
            used[s] += 1
    return single, patterns


def keys(segments: np.ndarray) -> np.ndarray:
    """For each 23-bit segment the indices of the codewords within 4 bits, a row of 6, -1 where there are fewer."""
    single, patterns = tables()
    s = np.zeros(len(segments), np.int64)
    for b in range(23):
        s ^= np.where(segments >> b & 1, single[b], 0)
    errors = patterns[s]
    return np.where(errors < 0, -1, (segments[:, None] ^ errors) >> 11)
