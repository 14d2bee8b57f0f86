"""Anchors: places in a text that depend only on the bytes around them."""

from __future__ import annotations

import numpy as np

#: Bytes of a repeated string, and of the gram whose hash makes an anchor.
LENGTH, GRAM = 400, 32
#: Grams in a window of LENGTH bytes.
SPAN = LENGTH - GRAM + 1
#: Starts of windows that are taken together when strings are compared by slices.
SHIFT = 47


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes that begin at each place."""
    h, base = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        width = 1
        while width < GRAM:
            h = h[:-width] * base + h[width:]
            base *= base
            width *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def running_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values that begin at each place."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[:len(x) - (width - have)], x[width - have:])


def _lower_sides(at: list[int], value: list[int], end: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one to the left that is not higher, or -1, and to the right that is lower, or `end`."""
    left, right, held = [], [end] * len(at), []
    for i, v in enumerate(value):
        while held and value[held[-1]] > v:
            right[held.pop()] = at[i]
        left.append(at[held[-1]] if held else -1)
        held.append(i)
    return np.array(left, np.int64), np.array(right, np.int64)


def anchored(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: their hashes, and the first and last start of the windows they stand for."""
    value, _, first, last = placed_anchors(text)
    return value, first, last


def placed_anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with the places of the anchors: hash, place, first start, last start.

    The anchor of a window of LENGTH bytes is the leftmost of its grams with the least hash. So every
    window has one anchor, and equal windows have it at the same place within them.
    """
    none = np.zeros(0, np.int64)
    if len(text) < LENGTH:
        return none, none, none, none
    h = gram_hashes(np.frombuffer(text, np.uint8))
    least = running_min(h, SPAN)
    edge = np.zeros(SPAN - 1, np.uint64)
    most = ~running_min(~np.concatenate([edge, least, edge]), SPAN)
    at = np.flatnonzero(h == most)
    value = h[at]
    # Windows end before an anchor of lower hash, and begin after one to the left that is not higher.
    left, right = _lower_sides(at.tolist(), value.tolist(), len(h))
    first = np.maximum(left + 1, np.maximum(at - SPAN + 1, 0))
    last = np.minimum(np.minimum(at, right - SPAN), len(text) - LENGTH)
    used = first <= last
    return value[used].view(np.int64), at[used], first[used], last[used]


def context_slices(string: bytes, place: int) -> list[tuple[int, bytes]]:
    """What the windows of a string share, by how far left of its anchor, which is at `place`, they begin.

    Windows that begin within one step of SHIFT bytes all hold the same LENGTH - SHIFT + 1 bytes. So two
    strings of one anchor that hold an equal window have an equal slice under the same number.
    """
    found = []
    for k in range(place // SHIFT + 1):
        begin, end = place - k * SHIFT, place - k * SHIFT + LENGTH - SHIFT + 1
        if end <= len(string):
            found.append((k, string[begin:end]))
    return found
