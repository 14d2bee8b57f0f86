"""The perfect binary code of length 23: decoding a word to all code words near it."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, DATA_BITS = 23, 12
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code (fixed value).
GENERATOR = 0b101011100011
#: Words at most two bits apart have a word between them, which is within 3 bits of a code word; so
#: both are within this distance of that code word.
REACH = 4


def remainders(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words, as polynomials, by the generator; zero for code words."""
    left = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - DATA_BITS - 1, -1):
        left ^= (left >> bit & 1) * (GENERATOR << (bit - LENGTH + DATA_BITS))
    return left


@cache
def patterns() -> tuple[np.ndarray, np.ndarray]:
    """By remainder: bit patterns of weight `REACH` or less that have it, and how many there are.

    A word with a code word within 2 bits has that one alone, any other has six.
    """
    flips = np.array([sum(1 << b for b in bits) for weight in range(REACH + 1)
                      for bits in combinations(range(LENGTH), weight)], np.int64)
    rest = remainders(flips)
    order = np.argsort(rest, kind="stable")
    sizes = np.bincount(rest, minlength=1 << (LENGTH - DATA_BITS))
    place = np.arange(len(flips)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    table = np.zeros((len(sizes), sizes.max()), np.int64)
    table[rest[order], place] = flips[order]
    return table, sizes


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """at, index: for each word, its place in `words` once per near code word, and that one's index."""
    table, sizes = patterns()
    rest = remainders(words)
    at = np.repeat(np.arange(len(words)), sizes[rest])
    columns = np.arange(len(at)) - np.repeat(np.cumsum(sizes[rest]) - sizes[rest], sizes[rest])
    return at, (words[at] ^ table[rest[at], columns]) >> (LENGTH - DATA_BITS)
