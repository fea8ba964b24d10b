"""Gradient-boosted trees for a binary label and isotonic calibration, on a bounded sample in memory."""

from __future__ import annotations

import numpy as np

#: Trees, depth, shrinkage, bins of a feature, least weight of a leaf and ridge of its value.
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 3, 0.2, 32, 2.0, 1.0


class Boosted:
    """Trees of fixed depth over binned features; each is an array of (feature, cut) splits and leaf values."""

    def __init__(self, start: float, splits: np.ndarray, cuts: np.ndarray, leaves: np.ndarray):
        self.start, self.splits, self.cuts, self.leaves = start, splits, cuts, leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for split, cut, leaf in zip(self.splits, self.cuts, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, split[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Fit log-loss by Newton steps, each tree level by level on histograms of gradients."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    inner = 2**DEPTH - 1
    splits, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        split, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            for j in range(width):
                key = (at - first) * BINS + binned[:, j]
                gs = np.bincount(key, g, count * BINS).reshape(count, BINS)
                hs = np.bincount(key, h, count * BINS).reshape(count, BINS)
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST) | (ht - hl < LEAST)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(count), top] > best + 1e-9):
                    best[k] = gain[k, top[k]]
                    split[first + k], cut[first + k] = j, edges[j][top[k]]
            at = 2 * at + 1 + (x[np.arange(n), split[at]] > cut[at])
        at -= inner
        leaf = RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + RIDGE)
        margin += leaf[at]
        splits.append(split)
        cuts.append(cut)
        leaves.append(leaf)
    return Boosted(start, np.array(splits), np.array(cuts), np.array(leaves))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y over score (pool adjacent violators): block means at the blocks' mean scores."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of score
    for s, v in zip(score[order], y[order]):
        blocks.append([1.0, float(v), float(s)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, a, b = blocks.pop()
            blocks[-1][0] += w
            blocks[-1][1] += a
            blocks[-1][2] += b
    found = np.array(blocks).reshape(-1, 3)
    return found[:, 2] / found[:, 0], found[:, 1] / found[:, 0]
