"""Gradient-boosted trees for several classes: histograms, fixed depth, softmax loss."""

from __future__ import annotations

import numpy as np


class Booster:
    """Complete trees of one depth, so that prediction is a few gathers for each level."""

    def __init__(self, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> Booster:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        self.base = np.log(np.bincount(y, minlength=classes) + 1.0)
        score = np.tile(self.base, (len(y), 1))
        for _ in range(self.rounds):
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for k in range(classes):
                grad, hess = p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
                tree = self._grow(binned, cuts, grad, hess)
                self.trees.append((k, *tree))
                score[:, k] += self._leaves(x, *tree)
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << self.depth) - 1
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node, width = np.zeros(len(grad), np.int64), self.bins + 1
        for level in range(self.depth):
            n, off = 1 << level, (1 << level) - 1
            local = node - off
            best = np.full(n, 1e-9)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                at = local * width + binned[:, f]
                g = np.bincount(at, grad, n * width).reshape(n, width)
                h = np.bincount(at, hess, n * width).reshape(n, width)
                gl, hl = g.cumsum(axis=1)[:, : len(c)], h.cumsum(axis=1)[:, : len(c)]
                gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                b = gain.argmax(axis=1)
                top = gain[np.arange(n), b]
                for j in np.flatnonzero(top > best):
                    best[j], feature[off + j], limit[off + j] = top[j], f, c[b[j]]
            chosen = feature[node]
            bin_limit = np.array([np.searchsorted(cuts[feature[i]], limit[i], "left") if np.isfinite(limit[i]) else width for i in range(off, off + n)])
            node = 2 * node + 1 + (binned[np.arange(len(node)), chosen] > bin_limit[local])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        return feature, limit, (-self.rate * g / (h + self.ridge)).astype(np.float32)

    def _leaves(self, x: np.ndarray, feature: np.ndarray, limit: np.ndarray, value: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
        return value[node - len(feature)]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        score = np.tile(self.base, (len(x), 1))
        for k, *tree in self.trees:
            score[:, k] += self._leaves(x, *tree)
        score -= score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))
