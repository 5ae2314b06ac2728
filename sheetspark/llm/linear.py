"""Sparse logistic regression with an L1 penalty in numpy, over rows of present features."""

from __future__ import annotations

import numpy as np


class Rows:
    """A table of ones: which of ``width`` columns each row has, with further dense columns."""

    def __init__(self, columns: list[np.ndarray], width: int, dense: np.ndarray | None = None):
        self.width, self.n = width, len(columns)
        self.cols = np.concatenate(columns).astype(np.int64) if columns else np.zeros(0, np.int64)
        self.rows = np.repeat(np.arange(self.n), [len(c) for c in columns])
        self.dense = np.zeros((self.n, 0)) if dense is None else dense

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n) + self.dense @ w[self.width :]

    def turned_times(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.cols, r[self.rows], self.width), self.dense.T @ r])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: Rows, y: np.ndarray, penalty: float, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the class-balanced log loss plus ``penalty`` times the weights' L1 norm.

    Accelerated proximal gradient steps; the step comes from the largest singular value. With one
    class only in ``y`` the weights are zero and the intercept says that class.
    """
    ones = float(y.sum())
    if ones in (0.0, float(len(y))):
        return np.zeros(x.width + x.dense.shape[1]), -8.0 if ones == 0 else 8.0
    share = np.where(y > 0, 0.5 / ones, 0.5 / (len(y) - ones))
    v = np.random.default_rng(0).normal(size=x.width + x.dense.shape[1])
    for _ in range(12):
        v = x.turned_times(share * x.times(v / (np.linalg.norm(v) or 1)))
    step = 1 / (0.25 * (np.linalg.norm(v) + 1) * 1.1)
    w = z = np.zeros(x.width + x.dense.shape[1])
    b = bz = 0.0
    t = 1.0
    for _ in range(rounds):
        r = share * (sigmoid(x.times(z) + bz) - y)
        new = z - step * x.turned_times(r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = bz - step * r.sum()
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, bz = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return w, b


def out_of_fold(x_of, y: np.ndarray, folds: np.ndarray, penalty: float) -> np.ndarray:
    """For each row the probability by a model fitted without the row's fold; ``x_of(rows)`` gives Rows."""
    out = np.zeros(len(y))
    for fold in np.unique(folds):
        inside = folds == fold
        w, b = fit(x_of(np.flatnonzero(~inside)), y[~inside], penalty)
        out[inside] = sigmoid(x_of(np.flatnonzero(inside)).times(w) + b)
    return out
