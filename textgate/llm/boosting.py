"""Histogram gradient-boosted trees for a binary label, in numpy.

Feature values are cut into at most 255 bins at training quantiles.  A tree grows level by
level: one ``bincount`` a feature sums gradients and curvatures of all open nodes' bins, and
the best cut of each node is read off the running sums.  The fitted trees are flattened into
parallel arrays (feature, threshold, left child, leaf value), which a batch of rows descends
together, one gather a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosting:
    trees: int = 80
    depth: int = 5
    rate: float = 0.1
    bins: int = 64
    ridge: float = 1.0
    min_rows: int = 20
    min_gain: float = 1e-6


@dataclass
class Forest:
    """``feature`` is -1 at a leaf; the right child follows the left one."""

    start: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                right = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(f < 0, node, self.left[node] + right)
            total += self.value[node]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def train(x: np.ndarray, y: np.ndarray, cfg: Boosting = Boosting()) -> Forest:
    """Fits logistic loss; without rows, or with one label alone, the forest is a constant."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(prior / (1 - prior)))
    feature, threshold, left, value, roots = [], [], [], [], []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cfg.bins + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else []
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, 0), np.int64)
    margin = np.full(len(y), start)
    for _ in range(cfg.trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        node = np.full(len(y), roots[-1])
        feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
        level = [roots[-1]]
        for depth in range(cfg.depth + 1):
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            own = slot[node]
            active = np.flatnonzero(own >= 0)
            own = own[active]
            gs, hs = (np.bincount(own, v[active], len(level)) for v in (g, h))
            for k, n in enumerate(level):
                value[n] = float(-cfg.rate * gs[k] / (hs[k] + cfg.ridge))
            if depth == cfg.depth:
                break
            best = np.full(len(level), cfg.min_gain)
            where: list[tuple[int, int] | None] = [None] * len(level)
            base = gs**2 / (hs + cfg.ridge)
            for f, c in enumerate(cuts):
                width = len(c) + 1
                key = own * width + binned[active, f]
                sums = [np.bincount(key, v, len(level) * width).reshape(len(level), width) for v in (g[active], h[active], np.ones(len(active)))]
                gl, hl, nl = (np.cumsum(s, axis=1)[:, :-1] for s in sums)
                if not gl.shape[1]:
                    continue
                n = sums[2].sum(axis=1)[:, None]
                gain = gl**2 / (hl + cfg.ridge) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + cfg.ridge) - base[:, None]
                gain[(nl < cfg.min_rows) | (n - nl < cfg.min_rows)] = -1
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(len(level)), at] > best):
                    best[k], where[k] = gain[k, at[k]], (f, int(at[k]))
            after = []
            for k, n in enumerate(level):
                if where[k] is None:
                    continue
                f, b = where[k]
                feature[n], threshold[n], left[n] = f, float(cuts[f][b]), len(feature)
                for _side in range(2):
                    after.append(len(feature))
                    feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
                mine = active[own == k]
                node[mine] = left[n] + (binned[mine, f] > b)
            level = after
            if not level:
                break
        margin += np.array(value)[node]
    if not roots:
        feature, threshold, left, value, roots = [-1], [0.0], [-1], [0.0], [0]
    return Forest(start, cfg.depth, np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots))
