"""Gradient-boosted trees for bounded training samples, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees of equal depth; node i of a tree has children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = 2**self.depth - 1
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Boosted:
    """Newton boosting of the logistic loss over quantile histograms."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = max((len(e) for e in edges), default=0) + 1
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    score = np.full(n, base)
    inner = 2**depth - 1
    features, cuts, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, c, v = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(2**depth)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            local = node - first
            best = np.full(2**level, 1e-6)
            gs, hs = np.bincount(local, g, 2**level), np.bincount(local, h, 2**level)
            root = gs**2 / (hs + l2)
            for j in range(m):
                if not len(edges[j]):
                    continue
                cell = local * width + code[:, j]
                gl = np.bincount(cell, g, 2**level * width).reshape(-1, width).cumsum(axis=1)
                hl = np.bincount(cell, h, 2**level * width).reshape(-1, width).cumsum(axis=1)
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - root[:, None]
                gain[(hl < least * 0.25) | (hr < least * 0.25)] = -1
                gain = gain[:, : len(edges[j])]
                k = gain.argmax(axis=1)
                top = gain[np.arange(len(k)), k]
                better = top > best
                best[better] = top[better]
                f[first : first + 2**level][better] = j
                c[first : first + 2**level][better] = edges[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > c[node])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        score += v[leaf]
        features.append(f)
        cuts.append(c)
        values.append(v)
    return Boosted(base, np.array(features), np.array(cuts), np.array(values), depth)


def calibrate(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of the logistic map from score to probability (Platt), by Newton's method."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -40, 40)))
        d, w = target - p, p * (1 - p) + 1e-9
        h = np.array([[np.sum(w * score * score) + 1e-3, np.sum(w * score)], [np.sum(w * score), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, np.array([np.sum(d * score) - 1e-3 * (a - 1), np.sum(d)]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def best_threshold(p: np.ndarray, y: np.ndarray, beta: float = 1.0) -> float:
    """The probability above which F-beta on held-out rows is greatest; halfway into its gap. A
    ``beta`` over 1 weighs what is missed more than what is taken too much."""
    if not len(p) or y.sum() == 0:
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f = (1 + beta**2) * hit / (np.arange(1, len(p) + 1) + beta**2 * y.sum())
    k = int(f.argmax())
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + below) / 2, 0.05, 0.95))
