"""Follow-the-regularised-leader (proximal) logistic regression over sparse rows, and calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Row = tuple[np.ndarray, np.ndarray, int]  # feature numbers, values, class


@dataclass
class Ftrl:
    """Multinomial model with per-coordinate rates and an elastic-net penalty (``l1``, ``l2``).

    With two classes it is the binary model on class 1: one weight column, logistic output. The
    last row of the state is the bias, which is not penalised.
    """

    n_features: int
    n_classes: int
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.0

    def __post_init__(self) -> None:
        self.columns = 1 if self.n_classes == 2 else self.n_classes
        self.z = np.zeros((self.n_features + 1, self.columns))
        self.n = np.zeros((self.n_features + 1, self.columns))

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        w[-1] = -z[-1] * self.alpha / (self.beta + np.sqrt(n[-1]))
        return w

    def learn(self, rows: list[Row], epochs: int, seed: int = 7) -> Ftrl:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for r in order.permutation(len(rows)):
                idx, val, y = rows[r]
                at, x = np.append(idx, self.n_features), np.append(val, 1.0)
                z, n = self.z[at], self.n[at]
                w = self._weights(z, n)
                p = probabilities(x @ w)
                target = float(y) if self.columns == 1 else np.eye(self.columns)[y]
                g = x[:, None] * (p - target)
                more = n + g * g
                self.z[at] = z + g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
                self.n[at] = more
        return self

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(features x columns, bias by column); L1 leaves most rows zero."""
        w = self._weights(self.z, self.n)
        return w[:-1], w[-1]


def probabilities(logits: np.ndarray) -> np.ndarray:
    """Softmax over the last axis, or the logistic function where that has one column."""
    if logits.shape[-1] == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -500, 500)))
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The divisor of the logits that minimises the log loss on held rows (golden section in its log)."""
    if not len(classes):
        return 1.0

    def loss(t: float) -> float:
        p = probabilities(logits / np.exp(t))
        got = np.where(classes == 1, p[:, 0], 1 - p[:, 0]) if p.shape[1] == 1 else p[np.arange(len(classes)), classes]
        return float(-np.log(np.maximum(got, 1e-12)).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def platt(logits: np.ndarray, classes: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic fit to held rows of two classes, with Platt's smoothed targets."""
    n1, n0 = float((classes == 1).sum()), float((classes == 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(classes == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    w = weights / weights.mean()
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = probabilities((x @ ab)[:, None])[:, 0]
        h = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (w * (p - target)) + 1e-3 * (ab - [1.0, 0.0]))
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        ab = ab - step
        if np.abs(step).max() < 1e-8:
            break
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)
