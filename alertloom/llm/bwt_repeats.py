"""Repeated windows of a text from its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the `depth` codes (below 512) that begin there, by prefix doubling.

    Code 0 ends a text: what stands after it is not compared. Only places whose rank is still shared
    are sorted again.
    """
    n = len(codes)
    stops = np.append(np.flatnonzero(codes == 0), n)
    room = (np.repeat(stops, np.diff(stops, prepend=-1))[:n] - np.arange(n)).astype(np.int32)
    padded = np.concatenate([codes, np.zeros(6, codes.dtype)])
    key = np.zeros(n, np.int64)
    for i in range(7):
        key <<= 9
        key |= padded[i:n + i]
    have = 7
    order = np.argsort(key)
    laid = key[order]
    del key, padded  # what is not needed any more goes at once: these arrays decide a task's memory
    rows = np.arange(n)
    rank = np.empty(n, np.int64)
    while True:
        place = order[rows]
        begins = np.flatnonzero(np.diff(laid, prepend=laid[:1] - 1))
        size = np.diff(np.append(begins, len(rows)))
        rank[place] = np.repeat(rows[begins], size)  # the first row of those that are alike
        if have >= depth:
            return order
        more = np.repeat(size > 1, size)
        del laid, begins, size
        more &= room[place] >= have
        rows, place = rows[more], place[more]
        if not len(rows):
            return order
        laid = rank[place] << 32 | rank[place + have]
        sort = np.argsort(laid)
        order[rows], laid = place[sort], laid[sort]
        have *= 2


def deep_neighbours(order: np.ndarray, codes: np.ndarray, depth: int) -> np.ndarray:
    """For each row of the suffix order whether it shares `depth` codes with the row before.

    Breadth-first backward extension: a level holds the intervals of strings of one length. Each is
    extended to the left by every code that the transform shows in it; where the extended interval
    ends, the rows on both sides share exactly the length of the string before, if no shorter one has
    told so before. Levels stop at `depth`: ends that are still open lie between rows that share more. Code 0
    ends a text and is never extended over. Runs of equal codes in the transform are taken together,
    so an interval of many like rows costs little.
    """
    n = len(order)
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    if not n:
        return open_[:n]
    turned = codes[order - 1]
    turned[order == 0] = 0
    begins = np.flatnonzero(np.diff(turned, prepend=turned[:1] - 1))
    length = np.diff(np.append(begins, n))
    code = turned[begins]
    run = np.repeat(np.arange(len(begins)), length)
    # Where each run's rows go when their code is put in front: after smaller codes, in order.
    by_code = np.argsort(code, kind="stable")
    target = np.empty(len(begins), np.int64)
    target[by_code] = np.cumsum(length[by_code]) - length[by_code]

    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        first = run[low]
        count = run[high - 1] - first + 1
        ends = np.cumsum(count)
        owner = np.repeat(np.arange(len(low)), count)
        at = np.arange(int(ends[-1])) - np.repeat(ends - count - first, count)
        used = code[at] > 0
        at, owner = at[used], owner[used]
        if not len(at):
            break
        begin = target[at] + np.maximum(low[owner] - begins[at], 0)
        end = target[at] + np.minimum(high[owner] - begins[at], length[at])
        key = owner * 512 + code[at]
        if len(key) > 1 and (count > 1).any():
            sort = np.argsort(key, kind="stable")
            key, begin, end = key[sort], begin[sort], end[sort]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        begin, end = begin[new], end[np.append(new[1:], len(key)) - 1]
        fresh = open_[end]
        low, high = begin[fresh], end[fresh]
        open_[high] = False
        if not len(low):
            break
    return open_[:n]


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, at which of its places a window of `length` bytes begins that the strings hold twice."""
    sizes = np.array([len(s) for s in strings])
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum(sizes + 1) - 1
    data[ends] = 0
    begins = ends - sizes
    whole = np.zeros(len(data), bool)
    windows = np.maximum(sizes - length + 1, 0)
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + windows, -1)
    whole = np.cumsum(edges[:-1]) > 0
    order = suffix_order(data, length)
    deep = deep_neighbours(order, data, length)
    pairs = np.flatnonzero(deep[1:] & whole[order[1:]] & whole[order[:-1]]) + 1
    found = np.zeros(len(data), bool)
    found[order[pairs]] = True
    found[order[pairs - 1]] = True
    return [found[b:b + w] for b, w in zip(begins, windows, strict=True)]
