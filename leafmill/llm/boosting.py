"""Gradient-boosted trees for small tables of numeric features, trained where they are used."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of depth two, fitted to the gradient of the logistic loss on binned features."""

    def __init__(self, rounds: int = 60, rate: float = 0.3, bins: int = 16, least: int = 8) -> None:
        self.rounds, self.rate, self.bins, self.least = rounds, rate, bins, least
        self.trees: list[tuple] = []
        self.base = 0.0

    def _between(self, values: np.ndarray) -> np.ndarray:
        """Cuts half-way between values, so that what was never seen falls to the nearer side."""
        cuts = (values[1:] + values[:-1]) / 2
        return cuts if len(cuts) <= self.bins else cuts[np.unique(np.concatenate([np.linspace(0, len(cuts) - 1, self.bins).astype(int), np.argsort(np.diff(values))[-4:]]))]

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best, where = 1e-9, (0, np.inf)
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for cut in self.cuts[f]:
                low = x[:, f] <= cut
                n = int(low.sum())
                if n < self.least or len(low) - n < self.least:
                    continue
                gl, hl = g[low].sum(), h[low].sum()
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                if gain > best:
                    best, where = gain, (f, float(cut))
        return where

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [self._between(np.unique(np.quantile(x[:, f], np.linspace(0, 1, 4 * self.bins + 1), method="nearest"))) for f in range(x.shape[1])]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        leaf = lambda g, h: float(g.sum() / (h.sum() + 1)) if len(g) else 0.0
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            f, cut = self._split(x, g, h)
            side = x[:, f] <= cut
            tree = [f, cut]
            for part in (side, ~side):
                f2, cut2 = self._split(x[part], g[part], h[part]) if part.any() else (0, np.inf)
                low = part & (x[:, f2] <= cut2)
                tree += [f2, cut2, leaf(g[low], h[low]), leaf(g[part & ~low], h[part & ~low])]
            self.trees.append(tuple(tree))
            score += self.rate * self._one(x, tree)
        return self

    @staticmethod
    def _one(x: np.ndarray, tree) -> np.ndarray:
        f, cut, fl, cl, ll, lh, fr, cr, rl, rh = tree
        return np.where(x[:, f] <= cut, np.where(x[:, fl] <= cl, ll, lh), np.where(x[:, fr] <= cr, rl, rh))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self.rate * self._one(x, tree)
        return 1 / (1 + np.exp(-score))
