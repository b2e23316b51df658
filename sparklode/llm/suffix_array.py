"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The steps are those of induced sorting: classify suffixes as smaller (S) or larger (L) than the next one, sort the substrings between
leftmost S positions, sort these positions' suffixes by recursion on the names of the substrings, and induce all L and then all S
suffixes from them. Induction goes bucket by bucket of the first byte: what a bucket's suffixes induce is written by one
vectorised step, and again for what that adds to the same bucket. As only prefixes of ``depth`` bytes matter here, the recursion
on names, which doubles the span of a name each time, ends once names span that much; suffixes that agree on more
than ``depth`` bytes may be in any order.
"""

from __future__ import annotations

import numpy as np


def _types(data: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last one is larger than the empty suffix."""
    n = len(data)
    differs = np.r_[data[1:] != data[:-1], True]
    smaller = np.r_[data[1:] > data[:-1], False]
    at = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return smaller[following]


def _place(slots: np.ndarray, edge: np.ndarray, values: np.ndarray, first: np.ndarray, step: int) -> None:
    """Append values to the buckets of their first bytes, at the heads (step 1) or before the tails (step -1)."""
    order = np.argsort(first, kind="stable")
    values, first = values[order], first[order]
    count = np.bincount(first, minlength=256)
    rank = np.arange(len(first)) - (np.cumsum(count) - count)[first]
    slots[edge[first] + rank if step > 0 else edge[first] - 1 - rank] = values
    edge += step * count


def _induce(data: np.ndarray, smaller: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffix array from leftmost S positions that are sorted (at least by their substrings)."""
    n = len(data)
    count = np.bincount(data, minlength=256)
    ends = np.cumsum(count)
    begins = ends - count
    slots = np.full(n, -1, np.int64)
    starts = starts[np.argsort(data[starts], kind="stable")]
    own = data[starts]
    of = np.bincount(own, minlength=256)
    slots[ends[own] - of[own] + np.arange(len(starts)) - (np.cumsum(of) - of)[own]] = starts
    heads = begins.copy()
    slots[heads[data[n - 1]]] = n - 1
    heads[data[n - 1]] += 1

    def induce(block: np.ndarray, edge: np.ndarray, kind: bool, step: int) -> None:
        before = block[block > 0] - 1
        before = before[smaller[before] == kind]
        if len(before):
            _place(slots, edge, before, data[before], step)

    for c in np.flatnonzero(count).tolist():
        done = begins[c]
        while done < heads[c]:
            block = slots[done : heads[c]]
            done = heads[c]
            induce(block, heads, False, 1)
        if of[c]:
            induce(slots[ends[c] - of[c] : ends[c]], heads, False, 1)
    tails = ends.copy()
    for c in np.flatnonzero(count)[::-1].tolist():
        done = ends[c]
        while done > tails[c]:
            block = slots[tails[c] : done][::-1]
            done = tails[c]
            induce(block, tails, True, -1)
        induce(slots[begins[c] : heads[c]][::-1], tails, True, -1)
    return slots


def _sort_names(names: np.ndarray, span: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names, each of which covers ``span`` bytes at least, by recursion on pairs of names."""
    if span >= depth or len(names) < 2 or names.max() == len(names) - 1:
        return names
    pair = names * (len(names) + 1) + np.r_[np.zeros(0, np.int64), names[_step(span) :] + 1, np.zeros(min(_step(span), len(names)), np.int64)]
    return _sort_names(np.unique(pair, return_inverse=True)[1], 2 * span, depth)


def _step(span: int) -> int:
    """Names span at least two bytes, so a name of ``span`` bytes covers span / 2 first names."""
    return span // 2


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes of ``data`` (uint8), in the order of their first ``depth`` bytes at least."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    smaller = _types(data)
    starts = np.flatnonzero(smaller & np.r_[True, ~smaller[:-1]])
    starts = starts[starts > 0]
    if not len(starts):
        return _induce(data, smaller, starts)
    order = _induce(data, smaller, starts)
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    sorted_starts = order[is_start[order]]
    following = np.full(n, n - 1)
    following[starts] = np.r_[starts[1:], n - 1]
    length = np.minimum(following[sorted_starts] - sorted_starts + 1, depth)
    a, b = sorted_starts[:-1], sorted_starts[1:]
    same = (length[1:] == length[:-1]) & (a != starts[-1]) & (b != starts[-1])  # the last one ends in the end of all
    live = np.flatnonzero(same)
    for i in range(depth):
        live = live[length[live] > i]
        if not len(live):
            break
        equal = data[a[live] + i] == data[b[live] + i]
        same[live[~equal]] = False
        live = live[equal]
    name = np.zeros(n, np.int64)
    name[sorted_starts] = np.cumsum(np.r_[0, ~same])
    ranks = _sort_names(name[starts], 2, depth + 2)
    return _induce(data, smaller, starts[np.argsort(ranks, kind="stable")])


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Permuted: for each position, the bytes it shares with the suffix before it in ``order``, up to ``depth``; both must not run beyond the end."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int16)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.ndarray(n + 1, "<u8", padded.tobytes(), strides=(1,))
    live = np.flatnonzero(before >= 0)
    at = 0
    while at < depth and len(live):
        live = live[(live + at < n) & (before[live] + at < n)]
        x = words[live + at] ^ words[before[live] + at]
        equal = x == 0
        rest = x[~equal]
        low = rest & (~rest + np.uint64(1))
        shared[live[~equal]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[equal]
        at += 8
        shared[live] = at
    return np.minimum(shared, depth)
