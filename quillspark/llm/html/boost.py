"""Gradient-boosted trees for a yes-or-no label, over histograms of at most 32 bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, BINS, LEAST = 80, 5, 0.2, 32, 6


@dataclass
class Boosted:
    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2^depth

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
    """Newton boosting of the logistic loss; splits by gain, leaves of some LEAST rows' curvature at a half.

    All nodes of a level are split at once. Yes-or-no columns are summed by a matrix product, others by histograms.
    """
    n, m = x.shape
    weight = np.ones(n) if weight is None else weight
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))[: BINS - 1] for c in x.T]
    two = np.array([len(np.unique(c)) <= 2 for c in x.T], bool)
    flags, many = np.flatnonzero(two), np.flatnonzero(~two)
    low = x[:, flags].min(0, initial=np.inf)
    is_low = (x[:, flags] == low).astype(np.float32)
    binned = np.stack([np.searchsorted(cuts[c], x[:, c], "left") for c in many], 1) if len(many) else np.zeros((n, 0), np.int64)
    binned += np.arange(len(many)) * BINS
    # the last bin of a column has no cut; neither has a column of one value
    open_ = np.array([[b < len(cuts[c]) for b in range(BINS - 1)] for c in many], bool).reshape(len(many), BINS - 1)
    mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    odds = np.full(n, np.log(mean / (1 - mean)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    model = Boosted(float(odds[0]) if n else 0.0, np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, leaves)))
    rows = np.arange(n)
    for k in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = at - first
            key = (local[:, None] * (len(many) * BINS) + binned).ravel()
            left, total = [], []
            for v in (g, h):
                own = np.zeros((n, width), np.float32)
                own[rows, local] = v
                flat = np.bincount(key, np.repeat(v, len(many)), width * len(many) * BINS).reshape(width, len(many), BINS).cumsum(2)
                left.append((own.T @ is_low, flat[:, :, :-1]))
                total.append(np.bincount(local, v, width))
            gains = []
            for gl, hl in zip(*left):
                gt, ht = (z.reshape(-1, *[1] * (gl.ndim - 1)) for z in total)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < LEAST / 40) | (ht - hl < LEAST / 40)] = -1
                gains.append(gain)
            gains[1][:, ~open_] = -1
            flat = np.concatenate([gains[0], gains[1].reshape(width, -1)], 1)
            best = flat.argmax(1)
            for node, b in enumerate(best):
                if flat[node, b] > 1e-3:
                    if b < len(flags):
                        model.feature[k, first + node], model.threshold[k, first + node] = flags[b], low[b]
                    else:
                        c, cut = divmod(int(b) - len(flags), BINS - 1)
                        model.feature[k, first + node], model.threshold[k, first + node] = many[c], cuts[many[c]][cut]
            at = 2 * at + 1 + (x[rows, model.feature[k, at]] > model.threshold[k, at])
        leaf = at - inner
        top, below = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        model.value[k] = RATE * top / (below + 1)
        odds += model.value[k][leaf]
    return model
