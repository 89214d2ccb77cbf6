"""Gradient-boosted trees for a yes or no, by histograms."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth on quantile bins; each adds to the log-odds."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 4.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.feature, self.cut, self.leaf, self.base = [], [], [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(f)], axis=1)
        p = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        size = self.bins + 1
        for _ in range(self.n_trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = weight * (y - prob), weight * np.maximum(prob * (1 - prob), 1e-6)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best, which, where = np.full(many, 1e-9), np.zeros(many, np.int64), np.full(many, size)
                for j in range(f):
                    key = (node - first) * size + b[:, j]
                    gs = np.bincount(key, g, many * size).reshape(many, size).cumsum(axis=1)
                    hs = np.bincount(key, h, many * size).reshape(many, size).cumsum(axis=1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl)**2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < self.least * 0.05) | (ht - hl < self.least * 0.05)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(many), k]
                    better = top > best
                    best, which, where = np.where(better, top, best), np.where(better, j, which), np.where(better, k, where)
                for i in range(many):
                    feature[first + i] = which[i]
                    if where[i] < len(self.edges[which[i]]):
                        cut[first + i] = self.edges[which[i]][where[i]]
                right = x[np.arange(n), feature[node]] > cut[node]
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            score = score + value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(value)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += leaf[node - (2**self.depth - 1)]
        return score
