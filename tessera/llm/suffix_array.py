"""Suffix arrays by recursive induced sorting, with whole buckets moved at once, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Names up to this many are letters of the next level down; more are written as two digits each.
MAX_LETTERS = 1024
STRIDE = 16


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it. The last suffix (the sentinel) counts as smaller."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _put(order: np.ndarray, edge: np.ndarray, found: np.ndarray, s: np.ndarray, step: int) -> None:
    """Place positions at the edges of their buckets, one after another, and move the edges on."""
    n = len(found)
    if n < 2:
        if n:
            c = s[found[0]]
            order[edge[c] - (step < 0)] = found[0]
            edge[c] += step
        return
    letters = s[found]
    by = letters.argsort(kind="stable")
    letters = letters[by]
    inner = np.flatnonzero(letters[1:] != letters[:-1])
    begin = np.zeros(len(inner) + 2, np.int64)
    begin[1:-1], begin[-1] = inner + 1, n
    count, begin = begin[1:] - begin[:-1], begin[:-1]
    at = letters[begin]
    first = edge[at] - step * begin - (step < 0)
    place = np.arange(n) if step > 0 else np.arange(0, -n, -1)
    place += np.repeat(first, count)
    order[place] = found[by]
    edge[at] += step * count


def _induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order all suffixes from the leftmost-smaller ones in ``seeds`` (in their order)."""
    size = np.bincount(s)
    ends = np.cumsum(size)
    starts = ends - size
    order = np.empty(len(s), np.int32 if len(s) < 1 << 31 else np.int64)
    tails = ends - np.bincount(s[seeds], minlength=len(size))
    _put(order, tails.copy(), seeds, s, 1)
    heads, present = starts.copy(), np.flatnonzero(size).tolist()
    # the last suffix stands before none, so its place serves the one before the first, which is to be left out
    up, down = ~smaller, smaller.copy()
    up[-1] = down[-1] = False

    def forward(todo):
        before = todo - 1
        _put(order, heads, before[up[before]], s, 1)

    for c in present:  # left to right: larger suffixes at the heads of their buckets
        at = starts[c]
        while at < heads[c]:
            at, todo = heads[c], order[at : heads[c]]
            forward(todo)
        if tails[c] < ends[c]:
            forward(order[tails[c] : ends[c]])
    tails = ends.copy()
    tails[s[-1]] -= 1
    order[tails[s[-1]]] = len(s) - 1

    def backward(todo):
        before = todo - 1
        _put(order, tails, before[down[before]], s, -1)

    for c in reversed(present):  # right to left: smaller suffixes at the tails
        at = ends[c]
        while at > tails[c]:
            at, todo = tails[c], order[tails[c] : at][::-1]
            backward(todo)
        if starts[c] < heads[c]:
            backward(order[starts[c] : heads[c]][::-1])
    return order


def _order_of(names: np.ndarray, n: int) -> np.ndarray:
    """Order of the suffixes of a string of names, whose last is smallest and alone, one level down."""
    most, m = int(names.max()) + 1, len(names)
    if most <= MAX_LETTERS or 2 * m > 0.9 * n:
        return suffix_array(names)
    base = int(np.ceil(np.sqrt(most)))
    digits = np.zeros(2 * m + 1, np.int64)
    digits[0:-1:2], digits[1::2] = names // base + 1, names % base + 1
    order = suffix_array(digits)[1:]
    return order[order % 2 == 0] // 2


def _names(s: np.ndarray, seeds: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings in text order, equal ones sharing one; and their number."""
    n = len(s)
    end = np.full(n, n - 1)
    end[seeds[:-1]] = seeds[1:]
    value = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(0xBF58476D1CE4E5B9 | 1))]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(0xBF58476D1CE4E5B9 | 1, -1, 1 << 64)))]))
    total = np.concatenate([[np.uint64(0)], np.cumsum((value ^ (value >> np.uint64(29))) * power[:n])])
    print_ = (total[end[order] + 1] - total[order]) * back[order]
    length = end[order] - order
    fresh = (print_[1:] != print_[:-1]) | (length[1:] != length[:-1])
    name = np.empty(n, np.int64)
    name[order[0]] = 0
    name[order[1:]] = np.cumsum(fresh)
    return name[seeds], int(fresh.sum()) + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """``text`` ends with a letter that is smaller than all others and stands nowhere else.

    Suffixes are classified, the leftmost-smaller substrings are sorted by
    inducing from their first letters and named, the string of names is sorted
    by the same method if names repeat, and all suffixes are induced.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    s = text.astype(np.uint16 if int(text.max()) < 1 << 16 else np.int64)
    smaller = _types(s)
    seeds = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(seeds) > 1:
        is_seed = np.zeros(n, bool)
        is_seed[seeds] = True
        rough = _induce(s, smaller, seeds)
        order = rough[is_seed[rough]]
        names, most = _names(s, seeds, order)
        seeds = order if most == len(seeds) else seeds[_order_of(names, n)]
    return _induce(s, smaller, seeds)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each place the common prefix, up to ``cap``, of its suffix with the one before it in ``order``; 0 for the first.

    A place's prefix is at least that of the place before it less one. Every
    ``STRIDE``-th place is worked out in full, and what it found is carried on
    from place to place in text order, all strides side by side.
    """
    n = len(text)
    before = np.full(n, n, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(cap + STRIDE, text.dtype)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(n, np.int64)
    for k in range(min(STRIDE, n)):
        place = np.arange(k, n, STRIDE)
        have = np.maximum(out[place - 1] - 1, 0) if k else np.zeros(len(place), np.int64)
        left = np.flatnonzero((before[place] < n) & (have < cap))
        have[before[place] == n] = 0
        while len(left):
            a, b = place[left] + have[left], before[place[left]] + have[left]
            same = eight[np.minimum(a, n)] == eight[np.minimum(b, n)]
            run = np.where(same.all(1), 8, np.argmin(same, 1))
            run = np.minimum(run, np.minimum(n - a, n - b))
            have[left] += run
            left = left[(run == 8) & (have[left] < cap)]
        out[place] = np.minimum(have, cap)
    return out
