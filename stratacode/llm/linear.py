"""Logistic regression on sparse binary features, for fits on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.clip(z, -60.0, 60.0)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class SparseRows:
    """Rows of present features (``row`` and ``column`` index pairs) beside a few dense columns."""

    def __init__(self, row: np.ndarray, column: np.ndarray, rows: int, columns: int, dense: np.ndarray) -> None:
        self.row, self.column, self.rows, self.columns, self.dense = row, column, rows, columns, dense

    def take(self, keep: np.ndarray) -> "SparseRows":
        new = np.cumsum(keep) - 1
        use = keep[self.row]
        return SparseRows(new[self.row[use]], self.column[use], int(keep.sum()), self.columns, self.dense[keep])

    def score(self, w: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.row, w[self.column], self.rows) if len(self.row) else np.zeros(self.rows)
        return sparse + self.dense @ w[self.columns :]

    def gradient(self, error: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.column, error[self.row], self.columns) if len(self.row) else np.zeros(self.columns)
        return np.concatenate([sparse, self.dense.T @ error])


def fit_logistic(x: SparseRows, y: np.ndarray, penalty: float = 1e-3, steps: int = 200, rate: float = 0.1) -> np.ndarray:
    """Weights that minimise the mean log loss plus ``penalty`` times the squared norm; the last dense column is the intercept, free of penalty."""
    w = np.zeros(x.columns + x.dense.shape[1])
    if not x.rows:
        return w
    free = np.ones_like(w)
    free[-1] = 0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = x.gradient(sigmoid(x.score(w)) - y) / x.rows + 2 * penalty * free * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w
