"""Sparse multinomial logistic regression: follow the regularised leader with
elastic-net penalties, and temperature calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Row = tuple[np.ndarray, np.ndarray]  # feature numbers and values


class Ftrl:
    """Per-coordinate FTRL-proximal; l1 keeps weights at exactly 0."""

    def __init__(self, features: int, classes: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.1, l2: float = 1.0):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        return self._shrunk(self.z[at], np.sqrt(self.n[at]))

    def _shrunk(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + root) / self.alpha + self.l2)

    def learn(self, row: Row, label: int, weight: float = 1.0) -> None:
        at, x = row
        z, n = self.z[at], self.n[at]
        root = np.sqrt(n)
        w = self._shrunk(z, root)
        p = softmax(x @ w)
        p[label] -= 1
        g = weight * x[:, None] * p
        more = n + g * g
        sigma = (np.sqrt(more) - root) / self.alpha
        self.z[at] = z + (g - sigma * w)
        self.n[at] = more

    def fit(self, rows: Sequence[Row], labels: Sequence[int], epochs: int, seed: int = 0) -> np.ndarray:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)).tolist():
                self.learn(rows[i], labels[i])
        return self.weights(slice(None))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores that gives held-back labels the least log loss."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    return float(min(grid, key=loss))
