"""What the two tokenizer operators share: merging by rank, and which tokens may be neighbours."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np




class Merger:
    """Byte-pair merging: the pair with the lowest rank is merged first, leftmost on a tie.

    `rank(a, b)` gives the rank of merging two tokens, or None. An encoding is a sequence in which
    every two neighbours `fit`: merging their joined text gives the same two tokens again. So the
    last token of a prefix's encoding is the one token that ends there and fits the last
    token of the prefix before it, and encodings can be found by one pass from left to right.
    """

    def __init__(self, rank: Callable[[Hashable, Hashable], int | None], limit: int = 1_000_000) -> None:
        self.rank, self.limit = rank, limit
        self._fits: dict = {}

    def merge(self, parts: list) -> list:
        parts = list(parts)
        ranks = [self.rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = self.rank(parts[at], parts[at + 1])
            if at:
                ranks[at - 1] = self.rank(parts[at - 1], parts[at])

    def fits(self, left, right, split: Callable) -> bool:
        """Whether the two tokens can stand side by side in an encoding."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= self.limit:  # only a cache: it is filled again
                self._fits.clear()
            known = self._fits[key] = self.merge(split(left) + split(right)) == [left, right]
        return known


class PairTable:
    """A hash table from integers to two integers that is read and filled by whole arrays."""

    EMPTY = -1

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.size = bits, 0
        self.keys = np.full(1 << bits, self.EMPTY, np.int64)
        self.first = np.zeros(1 << bits, np.int32)
        self.second = np.zeros(1 << bits, np.int16)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the empty slot where it would."""
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = (spread >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != self.EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found != self.EMPTY)]
        return at

    def put(self, keys: np.ndarray, first_values: np.ndarray, second_values: np.ndarray) -> None:
        if (self.size + len(keys)) * 2 >= len(self.keys):
            used = self.keys != self.EMPTY
            old = self.keys[used], self.first[used], self.second[used]
            self.__init__(max(self.bits, int(self.size + len(keys)).bit_length()) + 1)
            self.put(*old)
        self.size += len(keys)
        left = np.arange(len(keys))
        while len(left):  # of keys that want one slot, one gets it in each round
            at = self.place(keys[left])
            _, first = np.unique(at, return_index=True)
            mine, at = left[first], at[first]
            self.keys[at], self.first[at], self.second[at] = keys[mine], first_values[mine], second_values[mine]
            left = np.delete(left, first)
