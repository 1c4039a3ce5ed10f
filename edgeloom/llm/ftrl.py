"""Follow-the-regularised-leader, proximal: sparse linear models with a rate per coordinate.

Fitted on the driver from a bounded sample of sparse rows; the weights that are not exactly
zero are all that is sent to executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Ftrl:
    """``dims`` hashed features and a bias; ``classes`` columns, or one for a yes-or-no model."""

    dims: int
    classes: int = 1
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0

    def __post_init__(self):
        self.z = np.zeros((self.dims + 1, self.classes))
        self.n = np.zeros((self.dims + 1, self.classes))

    def at(self, index: np.ndarray) -> np.ndarray:
        """Weights of some coordinates; the elastic net leaves those with a small z at zero."""
        z = self.z[index]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, y: int, weight: float = 1.0) -> None:
        """One step: ``y`` is the class, or 0 or 1; the row counts ``weight`` times."""
        index = np.append(index, self.dims)
        value = np.append(value, 1.0)[:, None]
        w = self.at(index)
        score = (value * w).sum(0)
        if self.classes == 1:
            error = 1.0 / (1.0 + np.exp(-np.clip(score, -40, 40))) - y
        else:
            error = np.exp(score - score.max())
            error /= error.sum()
            error[y] -= 1.0
        g = value * error * weight
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], passes: int = 3, seed: int = 5, weights: dict[int, float] | None = None) -> None:
        """Passes over distinct-index rows in a seeded order; ``weights`` of classes are 1 unless given."""
        rng = np.random.default_rng(seed)
        for _ in range(passes):
            for i in rng.permutation(len(rows)):
                self.learn(*rows[i], y[i], 1.0 if weights is None else weights.get(y[i], 1.0))

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates with a weight, these weights, and the bias."""
        w = self.at(np.arange(self.dims))
        found = np.flatnonzero((w != 0).any(1))
        return found.astype(np.int32), w[found].astype(np.float32), self.at(np.array([self.dims]))[0]


def dense(dims: int, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The table of weights that an executor looks up."""
    out = np.zeros((dims, weights.shape[1]), np.float32)
    out[found] = weights
    return out
