"""Gradient-boosted trees for a logistic loss, on histograms of binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Full binary trees of one depth, stored level by level."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> Trees:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)])
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        base = np.log(share / (1 - share))
        at = np.full(n, base)
        inner = 2**depth - 1
        feature, cut, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, 2**depth))
        for t in range(rounds):
            p = 1 / (1 + np.exp(-at))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                width, first = 2**level, 2**level - 1
                best = np.full(width, 1e-6)
                choice = np.full((width, 2), -1)
                for j in range(d):
                    key = node * bins + binned[:, j]
                    gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                    hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                    gain = gain[:, : len(edges[j])]
                    if gain.shape[1]:
                        k = gain.argmax(axis=1)
                        better = gain[np.arange(width), k] > best
                        best[better] = gain[np.arange(width), k][better]
                        choice[better] = np.column_stack([np.full(width, j), k])[better]
                for w in range(width):
                    if choice[w, 0] >= 0:
                        feature[t, first + w] = choice[w, 0]
                        cut[t, first + w] = edges[choice[w, 0]][choice[w, 1]]
                node = node * 2 + (x[np.arange(n), feature[t, first + node]] > cut[t, first + node])
            gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            leaf[t] = -rate * gs / (hs + l2)
            at += leaf[t][node]
        return cls(base, feature, cut, leaf)

    def probability(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        at = np.full(n, self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for t in range(len(self.leaf)):
            node = np.zeros(n, np.int64)
            for level in range(depth):
                i = 2**level - 1 + node
                node = node * 2 + (x[np.arange(n), self.feature[t, i]] > self.cut[t, i])
            at += self.leaf[t][node]
        return 1 / (1 + np.exp(-at))
