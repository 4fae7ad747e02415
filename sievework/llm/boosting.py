"""Gradient-boosted trees for dense features, and isotonic calibration, in numpy.

Binary log loss, depth-limited trees over quantile bins, shrinkage. Training runs on the driver over a
labelled sample of bounded size; the model is a few kilobytes and goes to the tasks with their closure.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """An ensemble of complete binary trees of one depth, as arrays (tree, node)."""

    base: float
    depth: int
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), int))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boost ``trees`` trees on rows ``x`` with labels ``y`` in {0, 1}. Deterministic."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    # a feature that is mostly zero still gets a cut just above zero
    cuts = [np.unique(np.append(c, 0.0)) for c in cuts]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    width = max(map(len, cuts)) + 1
    # most features are mostly one value: only the other entries are added up, the rest follows from the totals
    usual = np.array([np.bincount(binned[:, j]).argmax() for j in range(d)])
    row, col = np.nonzero(binned != usual)
    place = col * width + binned[row, col]
    beyond = np.arange(width)[None, :] >= np.array([len(c) for c in cuts])[:, None]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    f = np.full(n, base)
    inner = 2**depth - 1
    feature, cut, leaf = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        tf, tc, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, int)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = node - first
            key = local[row] * (d * width) + place

            def sums(w: np.ndarray, key: np.ndarray = key, local: np.ndarray = local, wide: int = wide) -> tuple[np.ndarray, np.ndarray]:
                got, total = np.bincount(key, w[row], wide * d * width).reshape(wide, d, width), np.bincount(local, w, wide)
                got[:, np.arange(d), usual] += total[:, None] - got.sum(2)
                return got.cumsum(2), total[:, None, None]

            (lg, tg), (lh, th), (ln, tn) = sums(g), sums(h), sums(np.ones(n))
            gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
            gain[(ln < least) | (tn - ln < least) | beyond] = 0
            best = gain.reshape(wide, -1).argmax(1)
            for k in range(wide):
                j, b = divmod(int(best[k]), width)
                if gain[k, j, b] > 1e-9:
                    tf[first + k], tc[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), tf[node]] > tc[node])
        slot = node - inner
        values = rate * np.bincount(slot, g, 2**depth) / (np.bincount(slot, h, 2**depth) + ridge)
        f += values[slot]
        feature.append(tf), cut.append(tc), leaf.append(values)
    return Trees(base, depth, np.array(feature), np.array(cut), np.array(leaf))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) of the non-decreasing least-squares fit.

    Each pooled block is one knot at its mean score (centred isotonic regression), so that probabilities rise
    between blocks instead of standing still over a wide range of scores.
    """
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum of labels, count, sum of scores
    for a, b in zip(s, v, strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([t / n for _, n, t in blocks]), np.array([b / n for b, n, _ in blocks])


def calibrated(knots: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    """Probability of each score, linear between knots."""
    return np.interp(score, *knots)
