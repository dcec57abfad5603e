"""Gradient-boosted trees for small training tables: logistic loss, exact greedy splits, Newton leaves."""

from __future__ import annotations

import numpy as np


class Trees:
    """Fits on the driver over a bounded table; scoring is vectorised and the fitted object is a few kilobytes."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.base, self.trees, self.calibration = 0.0, [], (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree: list = []
            self._grow(tree, x, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _grow(self, tree: list, x, g, h, rows, depth) -> int:
        at, total_g, total_h = len(tree), g[rows].sum(), h[rows].sum()
        tree.append((-1, 0.0, 0, 0, float(-self.rate * total_g / (total_h + self.ridge))))
        best = (1e-6, -1, 0.0)
        for j in range(x.shape[1]) if depth else ():
            order = rows[np.argsort(x[rows, j], kind="stable")]
            v = x[order, j]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if len(cuts):
                lg, lh = np.cumsum(g[order])[cuts], np.cumsum(h[order])[cuts]
                gain = lg**2 / (lh + self.ridge) + (total_g - lg) ** 2 / (total_h - lh + self.ridge) - total_g**2 / (total_h + self.ridge)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, float(v[cuts[k]] + v[cuts[k] + 1]) / 2)
        if best[1] >= 0:
            left = x[rows, best[1]] <= best[2]
            a = self._grow(tree, x, g, h, rows[left], depth - 1)
            b = self._grow(tree, x, g, h, rows[~left], depth - 1)
            tree[at] = (best[1], best[2], a, b, 0.0)
        return at

    @staticmethod
    def _walk(tree: list, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x)), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            j, cut, a, b, value = tree[at]
            if j < 0:
                out[rows] = value
            else:
                left = x[rows, j] <= cut
                todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Platt scaling on rows that the trees have not seen."""
        m, (a, b) = self.margin(x), (1.0, 0.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * m + b)))
            g = np.array([((p - y) * m).sum() + 1e-2 * (a - 1), (p - y).sum()])
            w = p * (1 - p)
            hess = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, g)
        self.calibration = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-(a * self.margin(x) + b)))
