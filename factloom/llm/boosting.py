"""Small boosted trees: fitted on a bounded table of labelled rows, scored as a column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """``feature <= cut`` goes left; a leaf has no feature and holds a value."""

    value: float
    feature: int | None = None
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.predict(x), self.right.predict(x))

    def column(self, features: Sequence[Column]) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(features[self.feature] <= self.cut, self.left.column(features)).otherwise(self.right.column(features))


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, ridge: float) -> Tree:
    weight = lambda g, h: g * g / (h + ridge)
    value, best = float(gradient.sum() / (hessian.sum() + ridge)), (1e-6, None, 0)
    for f in range(x.shape[1] if depth else 0):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            g, h = gradient[low].sum(), hessian[low].sum()
            gain = weight(g, h) + weight(gradient.sum() - g, hessian.sum() - h) - weight(gradient.sum(), hessian.sum())
            if gain > best[0]:
                best = (gain, f, int(cut))
    _, feature, cut = best
    if feature is None:
        return Tree(value)
    low = x[:, feature] <= cut
    grown = [_grow(x[m], gradient[m], hessian[m], depth - 1, ridge) for m in (low, ~low)]
    return Tree(value, feature, cut, *grown)


@dataclass(frozen=True)
class Boosted:
    trees: tuple[Tree, ...]
    rate: float
    base: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
        """Logistic loss; Newton leaf values. Rows are few by contract, features small integers."""
        share = float(np.clip(y.mean(), 0.01, 0.99))
        base = float(np.log(share / (1 - share)))
        total, trees = np.full(len(y), base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            trees.append(_grow(x, y - p, p * (1 - p), depth, ridge))
            total += rate * trees[-1].predict(x)
        return cls(tuple(trees), rate, base)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.base - self.rate * sum(t.predict(x) for t in self.trees)))

    def column(self, features: Sequence[Column]) -> Column:
        """The same probability as a column."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + F.lit(self.rate) * tree.column(features)
        return 1 / (1 + F.exp(-total))


def cutoff(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Smallest threshold at which the rows at or above it reach the precision; above 1 if there is none."""
    for t in np.unique(probability):
        chosen = probability >= t
        if t >= 0.5 and y[chosen].mean() >= precision:
            return float(t)
    return 1.1
