"""The binary Golay code of length 23: 4096 codewords, any word within 3 bits of exactly one."""

from __future__ import annotations

import functools

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code.
GENERATOR = 0b110001110101
LENGTH, DIMENSION, RADIUS = 23, 12, 3


def _remainder(word: np.ndarray) -> np.ndarray:
    """The 11 bits left of 23-bit words after division by the generator (the syndrome)."""
    r = word.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        r = np.where((r >> bit) & 1, r ^ (GENERATOR << (bit - (LENGTH - DIMENSION))), r)
    return r


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(error pattern of each syndrome, the weight-4 patterns that share its syndrome, padded with -1).

    Built from the polynomial: each of the 2048 syndromes has one pattern of
    weight 3 or less; a word whose pattern has weight 3 has five more
    codewords at distance 4.
    """
    bits = np.int64(1) << np.arange(LENGTH, dtype=np.int64)
    near = np.zeros(1 << (LENGTH - DIMENSION), dtype=np.int64)
    patterns = [np.zeros(1, dtype=np.int64)]
    for _ in range(RADIUS + 1):
        grown = patterns[-1][:, None] | bits[None, :]
        last = np.unique(grown[grown > patterns[-1][:, None]])
        patterns.append(last[np.bitwise_count(last) == len(patterns)])
    for p in patterns[: RADIUS + 1]:
        near[_remainder(p)] = p
    far = np.full((len(near), 8), -1, dtype=np.int64)
    filled = np.zeros(len(near), dtype=np.int64)
    four = patterns[RADIUS + 1]
    for p, s in zip(four.tolist(), _remainder(four).tolist()):
        far[s, filled[s]] = p
        filled[s] += 1
    return near, far[:, : filled.max()]


def home(words: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword within 3 bits of each 23-bit word."""
    near, _ = tables()
    return (words ^ near[_remainder(words)]) >> (LENGTH - DIMENSION)


def nearby(words: np.ndarray) -> np.ndarray:
    """Indices of all codewords within 4 bits of each word: first the home, then the rest, padded with -1.

    If two words differ in at most one bit, the home of either is among the
    nearby indices of the other.
    """
    near, far = tables()
    s = _remainder(words)
    first = (words ^ near[s]) >> (LENGTH - DIMENSION)
    rest = np.where(far[s] >= 0, (words[:, None] ^ far[s]) >> (LENGTH - DIMENSION), -1)
    return np.concatenate([first[:, None], rest], axis=1)
