"""Small gradient-boosted trees for binary labels, in numpy, for models that are fitted on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, threshold, leaf values of complete trees of one depth
    base: float
    a: float = 1.0
    b: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -40, 40)))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
    best, found = 1e-9, (0, np.inf)
    if len(g):
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f, cut in enumerate(cuts):
            if len(cut):
                bin_ = np.searchsorted(cut, x[:, f])
                gl, hl = np.cumsum(np.bincount(bin_, g, len(cut) + 1))[:-1], np.cumsum(np.bincount(bin_, h, len(cut) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                k = int(gain.argmax())
                if gain[k] > best:
                    best, found = gain[k], (f, cut[k])
    return found


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2) -> Boosted:
    """Second-order boosting of the logistic loss on features cut at up to 32 quantiles."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] if len(c) else c for f, c in enumerate(cuts)]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted([], float(np.log(p / (1 - p))))
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        inner = 2**depth - 1
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for node in range(inner):
            own = at == node
            feature[node], threshold[node] = _split(x[own], g[own], h[own], cuts)
            at[own] = 2 * node + 1 + (x[own, feature[node]] > threshold[node])
        at -= inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        model.trees.append((feature, threshold, leaf))
        margin += leaf[at]
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
    """Platt scaling on rows that the trees weren't fitted on."""
    m = model.margin(x)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(model.a * m + model.b, -40, 40)))
        w = q * (1 - q) + 1e-6
        grad = np.array([((y - q) * m).mean(), (y - q).mean()]) - np.array([1e-3 * model.a, 0])
        hess = np.array([[(w * m * m).mean() + 1e-3, (w * m).mean()], [(w * m).mean(), w.mean() + 1e-6]])
        da, db = np.linalg.solve(hess, grad)
        model.a, model.b = model.a + 0.5 * da, model.b + 0.5 * db
    return model


def threshold_for(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """A score above which at least this share of rows is positive, halfway to the next row below; above 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(hit >= precision)
    ranked = np.append(score[order], 0.0)
    return float(ranked[good[-1] : good[-1] + 2].mean()) if len(good) else 1.01
