"""Logistic regression on the driver, for bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Logistic:
    """Newton steps with an L2 penalty on standardised features; scores are linear in the raw ones."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30):
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-12] = 1.0
        z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
        ridge = np.full(z.shape[1], penalty)
        ridge[0] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = sigmoid(z @ w)
            gradient = z.T @ (y - p) - ridge * w
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(hessian, gradient)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w[1:] / scale
        self.intercept = float(w[0] - self.weights @ mean)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept
