"""Dense logistic regression by Newton steps, for a few dozen features."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-7, 1 - 1e-7)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights, the last of them the bias (not penalised beyond rounding)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pen = np.full(len(w), l2)
    pen[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + pen * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
