"""Gradient-boosted trees for a bounded training table, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary logistic boosting with trees of one depth, kept as flat arrays:
    node i of a tree has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, trees: int = 80, depth: int = 5, rate: float = 0.2, bins: int = 24, least: float = 8.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(cuts, x.T, strict=True)], 1)
        width = max(len(e) for e in cuts) + 1
        inner = 2 ** self.depth - 1
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, 2 ** self.depth))
        score = np.full(len(y), self.base)
        columns = np.arange(x.shape[1]) * width
        for t in range(self.trees):
            p = 1.0 / (1.0 + np.exp(-score))
            slope, curve = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first = 2 ** level - 1
                for own in range(first, 2 * first + 1):
                    rows = np.flatnonzero(node == own)
                    best = self._split(codes[rows] + columns, slope[rows], curve[rows], width, x.shape[1]) if len(rows) else None
                    if best is not None and best[1] < len(cuts[best[0]]):
                        self.feature[t, own], self.cut[t, own] = best[0], cuts[best[0]][best[1]]
                node = 2 * node + 1 + (x[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            up = np.bincount(leaf, slope, 2 ** self.depth)
            down = np.bincount(leaf, curve, 2 ** self.depth)
            self.leaf[t] = self.rate * up / (down + 1.0)
            score += self.leaf[t][leaf]
        return self

    def _split(self, codes, slope, curve, width, features):
        flat = codes.ravel()
        g = np.bincount(flat, np.repeat(slope, features), features * width).reshape(features, width).cumsum(1)
        h = np.bincount(flat, np.repeat(curve, features), features * width).reshape(features, width).cumsum(1)
        total_g, total_h = g[0, -1], h[0, -1]
        gain = g ** 2 / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0) - total_g ** 2 / (total_h + 1.0)
        n = np.bincount(flat, minlength=features * width).reshape(features, width).cumsum(1)
        gain[(n < self.least) | (n[:, -1:] - n < self.least)] = 0.0
        at = int(gain.argmax())
        return (at // width, at % width) if gain.ravel()[at] > 1e-6 else None

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += leaf[node - len(cut)]
        return 1.0 / (1.0 + np.exp(-score))
