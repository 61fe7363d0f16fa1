"""Context-tree weighting over bytes: the model itself, in numpy.

``ContextTree`` holds a whole tree. ``climb`` and ``descend`` weigh any set of
whole subtrees by themselves, so that a tree of any size can be dealt out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 5
END = 0xFF  # no byte of UTF-8 text
NODES = 255


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series after a shift by eight."""
    y = x + 8
    product = x * (x + 1) * (x + 2) * (x + 3)
    product2 = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(product) - np.log(product2)


def bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones met at the 255 nodes of the byte's binary decomposition; node 2^j - 1 + prefix."""
    n = len(counts)
    zeros, ones = np.empty((n, NODES)), np.empty((n, NODES))
    for level in range(8):
        halves = counts.reshape(n, 1 << level, 2, 1 << (7 - level)).sum(3)
        at = slice((1 << level) - 1, (1 << (level + 1)) - 1)
        zeros[:, at], ones[:, at] = halves[:, :, 0], halves[:, :, 1]
    return zeros, ones


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov block probability."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - 1.1447298858494002


def byte_logs(one: np.ndarray) -> np.ndarray:
    """log10 probability of each byte value from the probability of a one at each node."""
    out = np.zeros((len(one), 256))
    value = np.arange(256)
    for level in range(8):
        node = (1 << level) - 1 + (value >> (8 - level))
        bit = (value >> (7 - level)) & 1
        p = one[:, node]
        out += np.log10(np.where(bit, p, 1 - p))
    return out


def gram_array(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of depth + 1 bytes of all texts and their number by text. The context's last byte is highest, the byte after it lowest."""
    data = np.frombuffer(b"".join(bytes(depth) + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    gram = data.astype(np.int64)
    for k in range(1, depth + 1):
        gram[k:] |= data[: len(data) - k].astype(np.int64) << (8 * (depth + 1 - k))
    return gram[np.arange(sizes.sum()) + np.repeat((np.arange(len(texts)) + 1) * depth, sizes)], sizes


def gram_nodes(gram: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted grams: the decision nodes after ``bits`` bits, their zeros and ones, and the place of each gram's node."""
    node = gram >> (8 - bits)
    begins = np.r_[True, node[1:] != node[:-1]]
    starts = np.flatnonzero(begins)
    ones = np.add.reduceat(n * ((gram >> (7 - bits)) & 1), starts)
    return node[starts], np.add.reduceat(n, starts) - ones, ones, np.cumsum(begins) - 1


def climb(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, child: np.ndarray | None, bits: int, steps: int):
    """Weigh ``steps`` depths from the deepest up. Gives the layers for ``descend`` and, a depth above them, node, zeros, ones and log P_w of the children."""
    layers = []
    for _ in range(steps):
        own, weight = log_estimate(zeros, ones), np.ones(len(node))
        if child is not None:
            estimate = own - np.log(2)
            own = np.logaddexp(estimate, child - np.log(2))
            weight = np.exp(np.minimum(estimate - own, 0))
        above, up = np.unique(((node >> (bits + 8)) << bits) | (node & ((1 << bits) - 1)), return_inverse=True)
        layers.append((up, weight, (ones + 0.5) / (zeros + ones + 1)))
        node, zeros, ones, child = above, np.bincount(up, zeros), np.bincount(up, ones), np.bincount(up, own)
    return layers, node, zeros, ones, child


def descend(layers: list, alpha: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of a one mixed so far, and the weight left for what is deeper, from above the layers to the deepest."""
    for up, weight, one in reversed(layers):
        alpha, beta = alpha[up] + beta[up] * weight * one, beta[up] * (1 - weight)
    return alpha, beta


@dataclass
class ContextTree:
    """keys: per depth the sorted contexts; first: number of the first state of each depth; logs: by state and byte."""

    keys: list[np.ndarray]
    first: list[int]
    logs: np.ndarray
    short: np.ndarray  # the deepest state of up to two bytes, by the last two bytes

    @classmethod
    def weigh(cls, levels: list[tuple[np.ndarray, np.ndarray]]) -> ContextTree:
        """``levels[d]`` holds the kept contexts of d bytes, sorted, and their counts of next bytes.

        What a context has seen under contexts that are not kept is one more
        child, a leaf. P_w = (P_e + product of the children's P_w) / 2.
        """
        depth = len(levels) - 1
        keys = [k for k, _ in levels]
        first = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).tolist()
        mask = lambda d: (1 << (8 * d)) - 1
        parent = [np.zeros(0, np.int64)] + [np.searchsorted(keys[d - 1], keys[d] & mask(d - 1)) for d in range(1, depth + 1)]
        weight: list[np.ndarray] = [np.zeros(0)] * (depth + 1)
        below: np.ndarray | None = None  # log P_w of the depth below
        for d in range(depth, -1, -1):
            n = len(keys[d])
            own = np.empty((n, NODES))
            weight[d] = np.ones((n, NODES), np.float32)
            child_sum = np.zeros((n, NODES))
            rest = levels[d][1].astype(np.float64)
            if d < depth and len(keys[d + 1]):
                np.add.at(child_sum, parent[d + 1], below)
                rest = rest.copy()
                np.subtract.at(rest, parent[d + 1], levels[d + 1][1])
            for at in range(0, n, 2048):
                part = slice(at, at + 2048)
                estimate = log_estimate(*bit_counts(levels[d][1][part].astype(np.float64)))
                if d < depth:
                    split = child_sum[part] + log_estimate(*bit_counts(np.maximum(rest[part], 0)))
                    own[part] = np.logaddexp(estimate, split) - np.log(2)
                    weight[d][part] = np.exp(np.minimum(estimate - np.log(2) - own[part], 0))
                else:
                    own[part] = estimate
            below = own
        logs = np.empty((first[-1], 256), np.float32)
        alpha, beta = np.zeros((1, NODES), np.float32), np.ones((1, NODES), np.float32)
        for d in range(depth + 1):
            n = len(keys[d])
            up = parent[d] if d else np.zeros(n, np.int64)
            new_alpha, new_beta = np.empty((n, NODES), np.float32), np.empty((n, NODES), np.float32)
            rest = levels[d][1].astype(np.float64)
            if d < depth and len(keys[d + 1]):
                rest = rest.copy()
                np.subtract.at(rest, parent[d + 1], levels[d + 1][1])
            for at in range(0, n, 2048):
                part = slice(at, at + 2048)
                zeros, ones = bit_counts(levels[d][1][part].astype(np.float64))
                w = weight[d][part]
                new_alpha[part] = alpha[up[part]] + beta[up[part]] * w * ((ones + 0.5) / (zeros + ones + 1))
                new_beta[part] = beta[up[part]] * (1 - w)
                zeros, ones = bit_counts(np.maximum(rest[part], 0))
                one = new_alpha[part] + new_beta[part] * ((ones + 0.5) / (zeros + ones + 1))
                logs[first[d] + at : first[d] + at + len(one)] = byte_logs(np.clip(one, 1e-12, 1 - 1e-12))
            alpha, beta = new_alpha, new_beta
        short = np.zeros(65536, np.int64)
        last = np.arange(65536)
        for d in (1, 2):
            if d <= depth and len(keys[d]):
                at = np.minimum(np.searchsorted(keys[d], last & mask(d)), len(keys[d]) - 1)
                short = np.where(keys[d][at] == last & mask(d), first[d] + at, short)
        return cls(keys, first, logs, short)

    def log_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        depth = len(self.keys) - 1
        padded = b"".join(bytes(depth) + t + bytes([END]) for t in texts)
        data = np.frombuffer(padded, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(sizes.sum()) + np.repeat((np.arange(len(texts)) + 1) * depth, sizes)
        wide = np.zeros(len(data) + 1, np.int64)
        for k in range(1, depth + 1):
            wide[k:] |= data[: len(data) - k + 1].astype(np.int64) << (8 * (k - 1))
        context = wide[place]
        state = self.short[context & 0xFFFF]
        todo = np.arange(len(context))
        for d in range(depth, 2, -1):
            keys = self.keys[d]
            if not len(keys) or not len(todo):
                continue
            want = context[todo] & ((1 << (8 * d)) - 1)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            state[todo[hit]] = self.first[d] + at[hit]
            todo = todo[~hit]
        return np.add.reduceat(self.logs.ravel()[state * 256 + data[place]].astype(np.float64), begin)
