"""Gradient-boosted trees of depth two with logistic loss, for small bounded training sets."""

from __future__ import annotations

import math

import numpy as np


class Boosted:
    """Additive model of depth-two trees over a few dozen numeric features, split at bins of their quantiles."""

    def __init__(self, rounds: int = 60, rate: float = 0.3, bins: int = 24, least: int = 10):
        self.rounds, self.rate, self.bins, self.least = rounds, rate, bins, least
        self.bias = 0.0
        self.trees: list[tuple] = []

    @staticmethod
    def _leaf(g: float, h: float) -> float:
        return float(g / (h + 1.0))

    def _split(self, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, int, float, float] | None:
        """(feature, bin, value of the lower side, value of the upper side) with the greatest gain."""
        gr, hr = g[rows], h[rows]
        g_all, h_all, best = gr.sum(), hr.sum(), None
        for j, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            at = self.binned[rows, j]
            size = len(cuts) + 1
            n, gs, hs = (np.bincount(at, weights=w, minlength=size)[:-1].cumsum() for w in (None, gr, hr))
            gain = gs**2 / (hs + 1.0) + (g_all - gs) ** 2 / (h_all - hs + 1.0)
            gain[(n < self.least) | (len(rows) - n < self.least)] = -1.0
            k = int(gain.argmax())
            if gain[k] - g_all**2 / (h_all + 1.0) > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k, self._leaf(gs[k], hs[k]), self._leaf(g_all - gs[k], h_all - hs[k]))
        return best[1:] if best else None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, self.bins))) for j in range(x.shape[1])]
        self.binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        p0 = min(0.99, max(0.01, float(y.mean())))
        self.bias = float(np.log(p0 / (1 - p0)))
        f = np.full(len(x), self.bias)
        every = np.arange(len(x))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            g, h = y - p, p * (1 - p)
            top = self._split(g, h, every)
            if top is None:
                break
            j, k = top[:2]
            left = self.binned[:, j] <= k
            sides = []
            for rows in (every[left], every[~left]):
                s = self._split(g, h, rows)
                sides.append((0, np.inf, self._leaf(g[rows].sum(), h[rows].sum()), 0.0) if s is None else (s[0], float(self.cuts[s[0]][s[1]]), s[2], s[3]))
            tree = (j, float(self.cuts[j][k]), *sides)
            self.trees.append(tree)
            f += self.rate * self._one(tree, x)
        del self.binned
        return self

    @staticmethod
    def _one(tree: tuple, x: np.ndarray) -> np.ndarray:
        j, c, lo, hi = tree
        side = [np.where(x[:, k] <= t, a, b) for k, t, a, b in (lo, hi)]
        return np.where(x[:, j] <= c, side[0], side[1])

    def predict_one(self, x: list[float]) -> float:
        """As predict, for one row; without arrays, which would cost more than the trees."""
        f = self.bias
        for j, c, lo, hi in self.trees:
            k, t, a, b = lo if x[j] <= c else hi
            f += self.rate * (a if x[k] <= t else b)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, f))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for t in self.trees:
            f += self.rate * self._one(t, x)
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))
