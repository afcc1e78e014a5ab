"""The binary Golay code of 23 bits, and the codewords near a word as keys for fuzzy matching.

Every 23-bit word lies within 3 bits of exactly one codeword. The codewords within 4 bits are
that one and, if it is exactly 3 away, the five that lie 7 from it and hold the three wrong
bits. Two words that differ in at most two bits share at least one of these (at most six)
codewords, because the five cover every other bit once.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, MESSAGE_BITS, NEAR = 23, 12, 6
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of polynomials over two elements by the generator: the syndrome, 11 bits."""
    rest = words.astype(np.int64).copy()
    for shift in range(MESSAGE_BITS - 1, -1, -1):
        rest ^= ((rest >> (shift + 11)) & 1) * (GENERATOR << shift)
    return rest


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of at most 3 bits, and that error's distances to near codewords."""
    patterns = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(BITS), n)]
    errors = np.zeros(1 << 11, dtype=np.int64)
    errors[_remainder(np.array(patterns))] = patterns
    codewords = np.arange(1 << MESSAGE_BITS, dtype=np.int64) << 11
    codewords |= _remainder(codewords)
    lightest = codewords[np.bitwise_count(codewords) == 7]
    near = np.zeros((1 << 11, NEAR), dtype=np.int64)
    for syndrome, error in enumerate(errors.tolist()):
        if error.bit_count() == 3:
            near[syndrome, 1:] = lightest[(lightest & error) == error]
    return errors, near


def near_codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word, the 12-bit indices of six codewords; fewer than six are repeated."""
    errors, near = _tables()
    syndrome = _remainder(words)
    nearest = words.astype(np.int64) ^ errors[syndrome]
    return (nearest[:, None] ^ near[syndrome]) >> 11
