"""Gradient-boosted trees for binary labels on small samples: numpy only, deterministic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees of one depth in heap order: feature and cut of each inner node, score of each leaf."""

    depth: int
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - (2**self.depth - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of the positive class."""
        return 1 / (1 + np.exp(-(self.slope * self.score(x) + self.shift)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 3.0) -> Forest:
    """Boosts logistic loss with histogram splits; least: hessian weight a child needs."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    flat = binned + np.arange(width) * bins
    base = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    start = float(np.log(base / (1 - base)))
    score = np.full(n, start)
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut, place = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner, np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(node == k)
                if len(mine) < 2:
                    continue
                cells = flat[mine].ravel()
                g = np.bincount(cells, np.repeat(grad[mine], width), width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(cells, np.repeat(hess[mine], width), width * bins).reshape(width, bins).cumsum(1)
                tg, th = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (tg - g) ** 2 / (th - h + ridge) - tg**2 / (th + ridge)
                gain[(h < least) | (th - h < least)] = -1
                best = int(gain.argmax())
                j, b = divmod(best, bins)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    feature[k], cut[k], place[k] = j, edges[j][b], b
            known = np.isfinite(cut[node])
            right = np.where(known, binned[np.arange(n), feature[node]] > place[node], False)
            node = 2 * node + 1 + right
        at = node - inner
        leaf = rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + ridge)
        score += leaf[at]
        features.append(feature)
        cuts.append(cut)
        values.append(leaf)
    return Forest(depth, np.array(features), np.array(cuts), np.array(values), start)


def calibrate(forest: Forest, x: np.ndarray, y: np.ndarray) -> tuple[Forest, float]:
    """Platt scaling on held-out rows, and the threshold with the best F1 there."""
    s = forest.score(x)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * s + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * s).sum() - 0.01 * (a - 1), (y - p).sum()])
        h = np.array([[(w * s * s).sum() + 0.01, (w * s).sum()], [(w * s).sum(), w.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.05, a + step[0]), b + step[1]
        if abs(step).max() < 1e-6:
            break
    forest.slope, forest.shift = float(a), float(b)
    p = forest.probability(x)
    grid = np.linspace(0.2, 0.8, 25)
    f1 = [2 * (y * (p >= t)).sum() / max(1, (p >= t).sum() + y.sum()) for t in grid]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return forest, float(grid[best[len(best) // 2]])
