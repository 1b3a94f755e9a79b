"""Small models over dense columns in numpy: boosted trees, isotonic calibration, lasso logistic regression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Trees:
    """Complete binary trees: node k of a tree has children 2k+1 (value below the cut) and 2k+2."""

    depth: int
    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] >= c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 8.0, ridge: float = 1.0) -> Trees:
    """Newton boosting on the logistic loss, with cuts at quantiles; without rows, or with one class, the base alone."""
    prior = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    model = Trees(depth, float(np.log(prior / (1 - prior))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="higher")) for j in range(x.shape[1])]
    # a rare value's cut is lost among quantiles: the least value above the smallest counts too
    cuts = [np.unique(np.append(c, x[x[:, j] > x[:, j].min(), j].min())) if (x[:, j] > x[:, j].min()).any() else c for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], 1)
    width = max(len(c) for c in cuts) + 1
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        p = sigmoid(raw)
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        inner = 2**depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            at = node - first
            for j, c in enumerate(cuts):
                key = at * width + binned[:, j]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                ns = np.bincount(key, minlength=count * width).reshape(count, width).cumsum(1)
                score = lambda a, b: a * a / (b + ridge)
                gain = score(gs, hs) + score(gs[:, -1:] - gs, hs[:, -1:] - hs) - score(gs[:, -1:], hs[:, -1:])
                gain[(ns < least) | (ns[:, -1:] - ns < least)] = 0
                top = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(count), top] > best):
                    if top[k] < len(c):
                        best[k], feature[first + k], cut[first + k] = gain[k, top[k]], j, c[top[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] >= cut[node])
        at = node - inner
        value = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        raw += value[at]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(value)
    return model


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y, by pooling adjacent violators; steps have a vote of each class."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest and highest raw
    for x in np.unique(raw[order]):
        rows = y[raw == x] if len(raw) < 2 else y[order][np.searchsorted(raw[order], x, "left") : np.searchsorted(raw[order], x, "right")]
        blocks.append([float(rows.sum()), float(len(rows)), x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = hi
    knots = [(k, (s + 0.05) / (w + 0.1)) for s, w, lo, hi in blocks for k in ((lo, hi) if hi > lo else (lo,))]
    value = np.maximum.accumulate(np.array([v for _, v in knots]))
    return np.array([k for k, _ in knots]), value


def fit_lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of logistic regression with an L1 penalty, by accelerated proximal steps; x has 0/1 columns."""
    n, k = x.shape
    w, b = np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    step = 4.0 / (1 + max(1e-9, float(np.linalg.norm(x, 2) ** 2) / n))
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = (sigmoid(x @ zw + zb) - y) / n
        new = zw - step * (x.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = zb - step * r.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        zw, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return b, w


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs of a 1 and a 0 in which the 1 scores higher, ties half."""
    values, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    pos = float(y.sum())
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / max(pos * (len(y) - pos), 1))
