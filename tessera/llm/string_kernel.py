"""Gap-weighted subsequence kernel between short strings, vectorised over many of them."""

from __future__ import annotations

import numpy as np

ORDER = 4
DECAY = 0.6
PIECE = 24
OVERLAP = 12


def encode(strings: list[str], width: int) -> np.ndarray:
    """Code points, padded with zero."""
    out = np.zeros((len(strings), width), np.int32)
    sizes = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    row = np.repeat(np.arange(len(strings)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def subsequence_kernel(left: np.ndarray, right: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """k(s, t): common subsequences of ``order`` characters, each weighted by decay to the power of its spans.

    ``left`` is (n, a), ``right`` (m, b); the result is (n, m). With d_k[i, j] the
    weight of common subsequences of k characters that end at s[i] and t[j],
    d_1 = decay^2 where s[i] = t[j], and d_{k+1}[i, j] sums d_k over earlier i and
    j, decayed by the distance. The sum over earlier i is carried from row to row.
    """
    n, m, b = len(left), len(right), right.shape[1]
    lam = np.float32(decay)
    carry = np.zeros((order - 1, b, n, m), np.float32)
    total = np.zeros((n, m), np.float32)
    columns = np.where(right == 0, -1, right).T
    for i in range(left.shape[1]):
        row = left[:, i, None]
        running = np.zeros((order - 1, n, m), np.float32)
        for j in range(b):
            same = row == columns[j][None, :]
            ends = [same * (lam * lam)]
            for k in range(1, order):
                ends.append(same * running[k - 1])
            total += ends[-1]
            running += carry[:, j]
            running *= lam
            for k in range(order - 1):
                carry[k, j] = (carry[k, j] + ends[k]) * lam
    return total


def common_subsequence_lengths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each ``left`` (n, a) with each ``right`` (m, b <= 31), a bit per character of ``right``."""
    letters = np.unique(right[right > 0])
    bits = np.zeros((len(letters) + 1, len(right)), np.uint32)
    for j in range(right.shape[1]):
        known = right[:, j] > 0
        bits[np.searchsorted(letters, right[known, j]), np.flatnonzero(known)] |= np.uint32(1 << j)
    at = np.minimum(np.searchsorted(letters, left), len(letters) - 1)
    at = np.where(letters[at] == left, at, len(letters))
    open_ = np.full((len(left), len(right)), (1 << right.shape[1]) - 1, np.uint32)
    for i in range(left.shape[1]):
        met = open_ & bits[at[:, i]]
        open_ = (open_ + met) | (open_ - met)
    return right.shape[1] - np.bitwise_count(open_ & np.uint32((1 << right.shape[1]) - 1)).astype(np.int64)


def pair_kernel(left: np.ndarray, right: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The kernel of ``left[k]`` with ``right[k]`` for each k."""
    n, b = len(left), right.shape[1]
    lam = np.float32(decay)
    carry = np.zeros((b, order - 1, n), np.float32)
    total = np.zeros(n, np.float32)
    columns = np.ascontiguousarray(np.where(right == 0, -1, right).T)
    for row in np.ascontiguousarray(left.T):
        running = np.zeros((order - 1, n), np.float32)
        for j in range(b):
            same = (row == columns[j]).astype(np.float32)
            total += same * running[-1]
            ends = np.empty((order - 1, n), np.float32)
            ends[0] = lam * lam
            ends[1:] = running[:-1]
            ends *= same
            running += carry[j]
            running *= lam
            carry[j] += ends
            carry[j] *= lam
    return total


def sparse_kernel(left: np.ndarray, right: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """``subsequence_kernel``, worked out for those pairs only that have ``order`` characters in common, in order; it is zero for the others."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.nonzero(common_subsequence_lengths(left, right) >= order)
    for at in range(0, len(a), 16_384):
        part = slice(at, at + 16_384)
        out[a[part], b[part]] = pair_kernel(left[a[part]], right[b[part]], order, decay)
    return out
