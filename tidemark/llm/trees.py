"""Small decision-tree learners in numpy: gradient boosting and bagging over one histogram tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Complete binary tree in arrays; a node that doesn't split sends everything left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.threshold[at])
        return self.value[at]


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points between distinct values, at most bins - 1 per feature."""
    out = []
    for j in range(x.shape[1]):
        u = np.unique(x[:, j])
        mid = (u[1:] + u[:-1]) / 2
        out.append(mid if len(mid) < bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])))
    return out


def grow(xb: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float, rng: np.random.Generator, share: float) -> Tree:
    """Level by level; the split with the greatest gain in (sum g)^2 / (sum h + ridge)."""
    n_nodes = 2 ** (depth + 1) - 1
    feature, threshold, value = np.zeros(n_nodes, np.int64), np.full(n_nodes, np.inf), np.zeros(n_nodes)
    bins = max((len(e) for e in edges), default=0) + 1
    at = np.zeros(len(g), np.int64)
    for level in range(depth + 1):
        first, width = 2**level - 1, 2**level
        gs, hs = np.bincount(at - first, g, width), np.bincount(at - first, h, width)
        value[first : first + width] = gs / (hs + ridge)
        if level == depth:
            break
        best, bf, bt = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, np.inf)
        chosen = np.flatnonzero(rng.random(xb.shape[1]) < share) if share < 1 else np.arange(xb.shape[1])
        for j in chosen:
            if not len(edges[j]):
                continue
            key = (at - first) * bins + xb[:, j]
            gl = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[j])]
            hl = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[j])]
            gr, hr = gs[:, None] - gl, hs[:, None] - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None]
            gain[(hl < least) | (hr < least)] = -1
            k = gain.argmax(1)
            top = gain[np.arange(width), k]
            better = top > best
            best[better], bf[better], bt[better] = top[better], j, edges[j][k[better]]
        feature[first : first + width], threshold[first : first + width] = bf, bt
        cut = np.array([np.searchsorted(edges[f], t) if np.isfinite(t) else bins for f, t in zip(bf, bt)])
        node = at - first
        at = 2 * at + 1 + (xb[np.arange(len(g)), bf[node]] > cut[node])
    return Tree(feature, threshold, value, depth)


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)


@dataclass
class Boosted:
    """Sum of trees on the log-odds scale."""

    trees: list[Tree]
    base: float
    rate: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least: float = 4.0, seed: int = 7) -> Boosted:
    """Gradient boosting of the logistic loss."""
    rng = np.random.default_rng(seed)
    edges = bin_edges(x, bins)
    xb = _binned(x, edges)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    f = np.full(len(y), np.log(p / (1 - p)))
    model = Boosted([], float(f[0]), rate)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        t = grow(xb, edges, y - q, q * (1 - q) + 1e-6, depth, least * 0.05, 1.0, rng, 0.8)
        model.trees.append(t)
        f += rate * t.predict(x)
    return model


@dataclass
class Bagged:
    """Mean of trees, each grown on its own bootstrap sample."""

    trees: list[Tree]

    def share(self, x: np.ndarray) -> np.ndarray:
        return np.clip(sum(t.predict(x) for t in self.trees) / len(self.trees), 0, 1)


def bag(x: np.ndarray, y: np.ndarray, n: int = 40, depth: int = 6, bins: int = 48, least: float = 3.0, seed: int = 7) -> Bagged:
    """Bagged regression trees on 0/1 labels (variance reduction is the Gini gain)."""
    rng = np.random.default_rng(seed)
    edges = bin_edges(x, bins)
    xb = _binned(x, edges)
    trees = []
    for _ in range(n):
        w = rng.poisson(1.0, len(y)).astype(float)
        trees.append(grow(xb, edges, w * y, w, depth, least, 1e-6, rng, 0.7))
    return Bagged(trees)
