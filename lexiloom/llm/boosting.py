"""Gradient-boosted regression trees over binned features, isotonic calibration, and cross-validation by group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete trees of one depth: at node k of a tree the row goes to 2k + 1 if its feature is at most the cut, else to 2k + 2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), (1 << self.depth) - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, trees: int = 150, depth: int = 3, rate: float = 0.1, bins: int = 64, least: float = 8.0, part: float = 0.7, seed: int = 7) -> Forest:
    """Least-squares boosting; each tree sees a random part of the rows, each leaf at least ``least`` of their weight."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    if not n:
        return Forest(0.0, depth, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.int64)
    width = bins + 1
    base = float(np.average(y, weights=weight))
    score, inner = np.full(n, base), (1 << depth) - 1
    forest = Forest(base, depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    flat = binned + np.arange(m) * width
    for t in range(trees):
        used = np.flatnonzero(rng.random(n) < part)
        w, g = weight[used], weight[used] * (y[used] - score[used])
        node = np.zeros(len(used), np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            if len(at):
                f, cut = _split(flat[used[at]], w[at], g[at], m, width, cuts, least)
                forest.feature[t, k], forest.cut[t, k] = f, cut
                node[at] = 2 * k + 1 + (x[used[at], f] > cut)
        total = np.bincount(node - inner, w, inner + 1)
        forest.leaf[t] = rate * np.divide(np.bincount(node - inner, g, inner + 1), total + 1.0)
        own = np.zeros(n, np.int64)
        for _ in range(depth):
            own = 2 * own + 1 + (x[np.arange(n), forest.feature[t][own]] > forest.cut[t][own])
        score += forest.leaf[t][own - inner]
    return forest


def _split(flat: np.ndarray, w: np.ndarray, g: np.ndarray, m: int, width: int, cuts: list, least: float) -> tuple[int, float]:
    """The feature and cut that lower the squared error most; a cut at infinity where none does."""
    size = m * width
    ws = np.bincount(flat.ravel(), np.repeat(w, m), size).reshape(m, width).cumsum(1)
    gs = np.bincount(flat.ravel(), np.repeat(g, m), size).reshape(m, width).cumsum(1)
    wt, gt = ws[:, -1:], gs[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gs**2 / ws + (gt - gs) ** 2 / (wt - ws) - gt**2 / wt
    gain[(ws < least) | (wt - ws < least) | ~np.isfinite(gain)] = -1
    f, b = divmod(int(gain.argmax()), width)
    return (f, float(cuts[f][b])) if gain[f, b] > 1e-9 and b < len(cuts[f]) else (0, np.inf)


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending step function nearest to y over score (pool adjacent violators): (scores, levels)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, w in zip(score[order], y[order], weight[order]):
        blocks.append([s, v, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            s2, v2, w2 = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [s2, (a[1] * a[2] + v2 * w2) / (a[2] + w2), a[2] + w2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def calibrated(steps: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    """Interpolated between the steps' ends."""
    return np.interp(score, *steps) if len(steps[0]) else score


def cross_predict(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, **settings) -> np.ndarray:
    """Predictions of each row by a forest that saw no row of its fold."""
    out = np.full(len(y), float(np.average(y, weights=weight)) if len(y) else 0.0)
    for k in np.unique(fold):
        test = fold == k
        if (~test).any():
            out[test] = fit(x[~test], y[~test], weight[~test], **settings).predict(x[test])
    return out
