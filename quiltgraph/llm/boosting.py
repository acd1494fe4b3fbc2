"""Gradient-boosted trees fitted in numpy, as nested tests that compile to a Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Split:
    """``feature <= bound`` goes left."""

    feature: int
    bound: float
    left: Split | float
    right: Split | float


@dataclass
class Boosted:
    start: float
    trees: list

    def margin(self, x: np.ndarray) -> np.ndarray:
        def value(node, rows):
            if not isinstance(node, Split):
                return np.full(len(rows), node)
            left = rows[:, node.feature] <= node.bound
            out = np.empty(len(rows))
            out[left], out[~left] = value(node.left, rows[left]), value(node.right, rows[~left])
            return out

        return self.start + sum((value(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        """The margin as an expression of feature columns."""

        def value(node) -> Column:
            if not isinstance(node, Split):
                return F.lit(float(node))
            return F.when(features[node.feature] <= F.lit(float(node.bound)), value(node.left)).otherwise(value(node.right))

        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + value(tree)
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 5, ridge: float = 1.0, bins: int = 256) -> Boosted:
    """Trees of the logistic loss by greedy splits on gradients and curvatures, summed by the values of each feature (or ``bins`` ranges of them)."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model, margin = Boosted(float(np.log(share / (1 - share))), []), np.full(len(y), np.log(share / (1 - share)))
    values = [np.unique(c) if len(np.unique(c)) <= bins else np.unique(np.quantile(c, np.linspace(0, 1, bins))) for c in x.T]
    # a row's place among a feature's values: at or below its own, above the one before
    codes = np.stack([np.searchsorted(v, c) for v, c in zip(values, x.T)], 1)
    kept = [f for f in range(x.shape[1]) if len(values[f]) > 1]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gr, hr = g[rows], h[rows]
        leaf = float(-rate * gr.sum() / (hr.sum() + ridge))
        if left == 0 or len(rows) < 2 * least:
            return leaf
        best = (1e-6, None, None)
        whole = gr.sum() ** 2 / (hr.sum() + ridge)
        for f in kept:
            c, size = codes[rows, f], len(values[f])
            n = np.cumsum(np.bincount(c, minlength=size))[:-1]
            gs, hs = (np.cumsum(np.bincount(c, w, size))[:-1] for w in (gr, hr))
            gain = gs**2 / (hs + ridge) + (gr.sum() - gs) ** 2 / (hr.sum() - hs + ridge) - whole
            gain[(n < least) | (n > len(rows) - least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] is None:
            return leaf
        _, f, k = best
        side = codes[rows, f] <= k
        # between the values that the rows here have
        upper = values[f][codes[rows, f][~side].min()]
        bound = float((values[f][codes[rows, f][side].max()] + upper) / 2) if len(values[f]) < bins else float(values[f][k])
        return Split(f, bound, grow(rows[side], g, h, left - 1), grow(rows[~side], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        model.trees.append(tree)
        margin = model.margin(x)
    return model
