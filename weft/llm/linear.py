"""Small logistic regressions on the driver: over hashed features of bounded samples, and over a few columns."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: flat feature numbers and values with offsets, every row scaled to length 1 unless it is scaled already; 12 bytes an entry."""

    def __init__(self, features: np.ndarray, values: np.ndarray, at: np.ndarray, scaled: bool = True):
        self.at, self.features = at, features.astype(np.int32, copy=False)
        self.row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
        if scaled:
            norm = np.sqrt(np.bincount(self.row, values**2, len(at) - 1))
            values = values / np.maximum(norm, 1e-12)[self.row]
        self.values = values.astype(np.float32)

    def plus(self, other: Rows) -> Rows:
        """These rows and then the others."""
        return Rows(np.concatenate([self.features, other.features]), np.concatenate([self.values, other.values]), np.concatenate([self.at, other.at[1:] + self.at[-1]]), scaled=False)

    def __len__(self) -> int:
        return len(self.at) - 1

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * weights[self.features], len(self))

    def back(self, residual: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.features, self.values * residual[self.row], size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray, size: int, start: np.ndarray | None = None, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights, the last one the bias, by Nesterov's method on the mean weighted log loss (``y`` may be soft), from ``start`` if given."""
    w = np.zeros(size + 1) if start is None else start.copy()
    v = w.copy()
    total = max(weight.sum(), 1e-12)
    rate = 1 / (0.25 * 2.0 + l2)  # rows have length 1, and the bias adds 1
    for k in range(steps):
        r = weight * (sigmoid(rows.times(v[:-1]) + v[-1]) - y) / total
        grad = np.append(rows.back(r, size), r.sum())
        grad[:-1] += l2 * v[:-1]
        new = v - rate * grad
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, pull: np.ndarray, steps: int = 60) -> np.ndarray:
    """Coefficients of the rows ``x[column, row]``, by Newton's method with halved steps; ``pull`` draws each towards ``start``."""

    def loss(w):
        m = w @ x
        return float(weight @ (np.logaddexp(0, m) - y * m) + 0.5 * pull @ (w - start) ** 2)

    w, now = start.copy(), loss(start)
    for _ in range(steps):
        p = sigmoid(w @ x)
        grad = x @ (weight * (p - y)) + pull * (w - start)
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))) @ x.T + np.diag(pull), grad)
        size = 1.0
        while size > 1e-6 and not loss(w - size * step) <= now:
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, shift) that turn margins into log odds, with a light pull to the prior."""
    total = max(weight.sum(), 1e-12)
    mean = float(weight @ margin / total)
    spread = max(float(np.sqrt(weight @ (margin - mean) ** 2 / total)), 1e-9)
    prior = float(weight @ y / total)
    start = np.array([0.0, np.log((prior + 1e-3) / (1 - prior + 1e-3))])
    a, b = logistic(np.stack([(margin - mean) / spread, np.ones_like(margin)]), y, weight, start, np.array([0.05, 1e-3]))
    return float(a / spread), float(b - a * mean / spread)
