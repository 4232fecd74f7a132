"""Sparse multinomial logistic regression by follow-the-regularised-leader with an elastic net."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    """Weights of the features that have any, one column for each class, and the intercepts; temperature divides logits."""

    features: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray
    temperature: float = 1.0

    def table(self, size: int) -> np.ndarray:
        out = np.zeros((size, self.intercept.size))
        out[self.features] = self.weights
        return out

    def logits(self, table: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return (value @ table[index] + self.intercept) / self.temperature


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0, epochs: int = 3, seed: int = 7) -> Model:
    """FTRL-proximal over the rows (index, value of any number type) in shuffled order; the intercept is not penalised."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    bz, bn = np.zeros(classes), np.zeros(classes)
    order = np.random.default_rng(seed)

    def weight(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, value = rows[i][0], np.asarray(rows[i][1], float)
            zi, ni = z[index], n[index]
            w, b = weight(zi, ni, l1, l2), weight(bz, bn, 0.0, 0.0)
            p = softmax(value @ w + b)
            p[labels[i]] -= 1
            for g, zz, nn, ww, put in ((value[:, None] * p[None, :], zi, ni, w, index), (p, bz, bn, b, None)):
                sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
                if put is None:
                    bz, bn = zz + g - sigma * ww, nn + g * g
                else:
                    z[put], n[put] = zz + g - sigma * ww, nn + g * g
    met = np.flatnonzero(z.any(1))  # features not met have no weight
    w = weight(z[met], n[met], l1, l2)
    used = w.any(1)
    return Model(met[used], w[used], weight(bz, bn, 0.0, 0.0))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    lo, hi, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
