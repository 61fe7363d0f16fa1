"""Small boosted trees over whole-number features, fitted to counted profiles and compiled into one Column.

A profile is a combination of feature values with the numbers of positive and
negative cases that have it. There are as many profiles at most as combinations of
values, whatever the number of cases, so all cases count in the fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    """Cases with ``feature <= value`` go left. A leaf is a float."""

    feature: str
    value: int
    left: Split | float
    right: Split | float


def fit_trees(names: list[str], values: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> list[Split | float]:
    """Trees of second-order logistic boosting; ``values`` is profiles x features."""
    total = positive + negative
    margin = np.zeros(len(values))
    trees: list[Split | float] = []
    if not total.sum():
        return trees

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> Split | float:
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(rate * gs / (hs + ridge))
        best, at = 1e-9, None
        if level:
            for f in range(values.shape[1]):
                for v in np.unique(values[rows, f])[:-1]:
                    left = rows[values[rows, f] <= v]
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    if gain > best:
                        best, at = gain, (f, int(v))
        if at is None:
            return leaf
        inside = values[rows, at[0]] <= at[1]
        return Split(names[at[0]], at[1], grow(rows[inside], g, h, level - 1), grow(rows[~inside], g, h, level - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(np.arange(len(values)), positive - total * p, np.maximum(total * p * (1 - p), 1e-12), depth))
        margin = margins(trees, names, values)
    return trees


def margins(trees: list[Split | float], names: list[str], values: np.ndarray) -> np.ndarray:
    """Summed leaves of each row of ``values``."""
    out = np.zeros(len(values))

    def walk(tree, rows):
        if isinstance(tree, Split):
            inside = values[rows, names.index(tree.feature)] <= tree.value
            walk(tree.left, rows[inside])
            walk(tree.right, rows[~inside])
        else:
            out[rows] += tree

    for tree in trees:
        walk(tree, np.arange(len(values)))
    return out


def compiled(trees: list[Split | float], feature) -> Column:
    """The trees as one expression; ``feature(name)`` gives the Column of a feature."""

    def column(tree) -> Column:
        if isinstance(tree, Split):
            return F.when(feature(tree.feature) <= F.lit(tree.value), column(tree.left)).otherwise(column(tree.right))
        return F.lit(float(tree))

    total = F.lit(0.0)
    for tree in trees:
        total = total + column(tree)
    return total


def threshold(margin: np.ndarray, positive: np.ndarray, negative: np.ndarray, precision: float) -> float:
    """Margin from which on the calibrated share of positives is ``precision`` or more, 0 at least; infinity if there is none.

    Calibration is isotonic: neighbouring groups are pooled until the shares rise with
    the margin. The bound lies midway between the last pool that falls short and the
    first that doesn't, and at 0 if none falls short.
    """
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # least and greatest margin, positives, cases
    for i in order:
        if positive[i] + negative[i] == 0:
            continue
        pools.append([float(margin[i]), float(margin[i]), float(positive[i]), float(positive[i] + negative[i])])
        while len(pools) > 1 and (pools[-1][0] == pools[-2][1] or pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]):
            _, high, p, n = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + p, pools[-1][3] + n]
    fine = [low for low, _, p, n in pools if p >= precision * n]
    short = [high for _, high, p, n in pools if p < precision * n]
    return max((min(fine) + max(short)) / 2 if short else 0.0, 0.0) if fine else float("inf")
