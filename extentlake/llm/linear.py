"""Small linear models on the driver, fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, l2: float = 1e-4, rounds: int = 120) -> np.ndarray:
    """Weights (features + 1, outputs) of logistic regressions of the 0/1 columns of ``y`` on ``x``,
    the intercept last, by full-batch gradient steps with per-weight step sizes."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    y = y.reshape(len(y), -1).astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    share = (np.ones(len(x)) if weight is None else weight).astype(np.float32)[:, None]
    share = share / max(share.sum(), 1e-9)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        gradient = x.T @ ((sigmoid(x @ w) - y) * share) + l2 * w
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        step = 0.3 / (1 + t / rounds)
        w -= step * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return w


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) @ w[:-1] + w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def balanced(y: np.ndarray) -> np.ndarray:
    """Row weights that give both classes the same share."""
    ones = max(1, int(y.sum()))
    zeros = max(1, len(y) - int(y.sum()))
    return np.where(y > 0, 0.5 / ones, 0.5 / zeros)
