"""Small gradient-boosted trees on numpy: logistic loss, histogram splits. For training sets that
fit one machine by a stated bound; prediction is vectorised and runs inside tasks."""
from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge, self.least = rounds, depth, rate, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """x: rows by features, y: 0 or 1."""
        share = min(max(float(y.mean()), 1e-4), 1 - 1e-4) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, p - y, p * (1 - p), cuts)
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]):
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        node = np.zeros(len(g), np.int64)
        for k in range(nodes):
            mine = np.flatnonzero(node == k)
            if not len(mine):
                continue
            sg, sh = g[mine].sum(), h[mine].sum()
            value[k] = -self.rate * sg / (sh + self.ridge)
            if 2 * k + 2 >= nodes:
                continue
            best = (1e-6, -1, -1)
            for f, c in enumerate(cuts):
                b = binned[mine, f]
                lg = np.cumsum(np.bincount(b, g[mine], len(c) + 1))[:-1]
                lh = np.cumsum(np.bincount(b, h[mine], len(c) + 1))[:-1]
                if not len(lg):
                    continue
                gain = lg**2 / (lh + self.ridge) + (sg - lg)**2 / (sh - lh + self.ridge) - sg**2 / (sh + self.ridge)
                gain[(lh < self.least * 1e-2) | (sh - lh < self.least * 1e-2)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
            if best[1] >= 0:
                feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
                node[mine] = np.where(binned[mine, best[1]] <= best[2], 2 * k + 1, 2 * k + 2)
        return feature, cut, value

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of 1."""
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._apply(tree, x)
        return score

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of 1."""
        return 1 / (1 + np.exp(-self.score(x)))
