"""Gradient-boosted trees for two classes, small enough to be trained on the driver and sent with a task."""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np


class Boosted:
    """Depth-limited trees on binned features with the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[int, int, float]]] = []
        self.base = 0.0
        self._plain: list[list[float]] | None = None

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, share = self._binned(x), min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += leaf
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list, np.ndarray]:
        """A full tree as (feature, bin, value) by heap position; feature -1 is a leaf."""
        size = 2 ** (self.depth + 1) - 1
        tree, at, out = [(-1, 0, 0.0)] * size, np.zeros(len(g), dtype=int), np.zeros(len(g))
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            total, weight = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            if node < 2**self.depth - 1:
                for j in range(b.shape[1]):
                    n = len(self.edges[j]) + 1
                    left_g = np.cumsum(np.bincount(b[rows, j], g[rows], n))[:-1]
                    left_h = np.cumsum(np.bincount(b[rows, j], h[rows], n))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total - left_g) ** 2 / (weight - left_h + 1) - total**2 / (weight + 1)
                    gain[(left_h < self.least) | (weight - left_h < self.least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()))
            if best[1] < 0:
                value = self.rate * total / (weight + 1)
                tree[node] = (-1, 0, value)
                out[rows] = value
            else:
                tree[node] = (best[1], best[2], 0.0)
                at[rows] = 2 * node + 1 + (b[rows, best[1]] > best[2])
        return tree, out

    def one(self, row: list[float]) -> float:
        """The chance of a single row, without arrays."""
        b, margin = [bisect_left(e, v) for e, v in zip(self._lists(), row)], self.base
        for tree in self.trees:
            at = 0
            feature, cut, value = tree[0]
            while feature >= 0:
                at = 2 * at + 1 + (b[feature] > cut)
                feature, cut, value = tree[at]
            margin += value
        return 1 / (1 + math.exp(-margin))

    def _lists(self) -> list[list[float]]:
        if self._plain is None:
            self._plain = [e.tolist() for e in self.edges]
        return self._plain

    def chance(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        if not len(x):
            return np.zeros(0)
        b, margin = self._binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                feature = np.array([t[0] for t in tree])[at]
                cut = np.array([t[1] for t in tree])[at]
                inner = feature >= 0
                right = b[np.arange(len(x)), np.maximum(feature, 0)] > cut
                at = np.where(inner, 2 * at + 1 + right, at)
            margin += np.array([t[2] for t in tree])[at]
        return 1 / (1 + np.exp(-margin))
