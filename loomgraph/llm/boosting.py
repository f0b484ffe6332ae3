"""Small gradient-boosted trees for binary labels, with Platt calibration; numpy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Additive trees of fixed depth: node i has children 2i+1 and 2i+2, leaves hold log-odds."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.2
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0.03, 0.97, 24))) for c in x.T]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        at = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-at))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for n in range(inner):
                rows = np.flatnonzero(node == n)
                if len(rows) >= 8:
                    feature[n], cut[n] = self._split(x[rows], g[rows], h[rows], cuts)
                node[rows] = 2 * n + 1 + (x[rows, feature[n]] > cut[n])
            leaf = np.array([g[node == inner + i].sum() / (h[node == inner + i].sum() + 1.0) for i in range(inner + 1)])
            at += self.rate * leaf[node - inner]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(self.rate * leaf)
        return self

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
        best, where = g.sum() ** 2 / (h.sum() + 1.0) + 1e-6, (0, np.inf)
        for f, options in enumerate(cuts):
            right = x[:, f][:, None] > options[None, :]
            gr, hr = g @ right, h @ right
            gain = gr**2 / (hr + 1.0) + (g.sum() - gr) ** 2 / (h.sum() - hr + 1.0)
            i = int(gain.argmax())
            if gain[i] > best:
                best, where = gain[i], (f, float(options[i]))
        return where

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, inner = np.full(len(x), self.base), (1 << self.depth) - 1
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Fit sigmoid(a * margin + b) on rows not used by `fit`."""
        m, (a, b) = self.margin(x), (1.0, 0.0)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((p - y) * m).sum() + 1e-2 * (a - 1), (p - y).sum()])
            hess = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        self.scale = (float(a), float(b))
        return self

    def chance(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -50, 50)))
