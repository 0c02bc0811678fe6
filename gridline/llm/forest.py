"""A small random forest for tables that fit a driver."""

from __future__ import annotations

import numpy as np


def _split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, float]:
    """The threshold of one feature with the lowest weighted Gini impurity, and that impurity."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n, ones = len(y), np.cumsum(y)
    left = np.arange(1, n)
    usable = (x[1:] > x[:-1]) & (left >= least) & (n - left >= least)
    if not usable.any():
        return 0.0, np.inf
    p, q = ones[:-1] / left, (ones[-1] - ones[:-1]) / (n - left)
    cost = np.where(usable, (left * p * (1 - p) + (n - left) * q * (1 - q)) / n, np.inf)
    at = int(cost.argmin())
    return (x[at] + x[at + 1]) / 2, float(cost[at])


class Forest:
    """Trees on bootstrap samples, each split over a few features drawn at random."""

    def __init__(self, trees: int = 40, depth: int = 10, least: int = 2, seed: int = 0):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.nodes: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        few = max(1, int(np.sqrt(x.shape[1])) + 1)
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []

            def grow(rows: np.ndarray, depth: int, nodes=nodes) -> int:
                own, here = y[rows], len(nodes)
                nodes.append([-1, 0.0, 0, 0, float(own.mean()) if len(own) else 0.5])
                if depth and len(own) >= 2 * self.least and 0 < own.sum() < len(own):
                    tried = [(*_split(x[rows, f], own, self.least)[::-1], f) for f in rng.permutation(x.shape[1])[:few]]
                    cost, at, feature = min(tried)
                    if np.isfinite(cost):
                        below = x[rows, feature] <= at
                        nodes[here][:2] = [feature, at]
                        nodes[here][2] = grow(rows[below], depth - 1)
                        nodes[here][3] = grow(rows[~below], depth - 1)
                return here

            grow(rows, self.depth)
            self.nodes.append(np.array(nodes))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of positives in the leaves that the rows of x reach."""
        total = np.zeros(len(x))
        for nodes in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                feature = nodes[at, 0].astype(int)
                inner = feature >= 0
                below = x[np.arange(len(x)), np.maximum(feature, 0)] <= nodes[at, 1]
                at = np.where(inner, np.where(below, nodes[at, 2], nodes[at, 3]).astype(int), at)
            total += nodes[at, 4]
        return total / max(1, len(self.nodes))
