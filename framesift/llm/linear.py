"""Logistic regression on sparse rows and probability calibration, fitted on bounded samples with numpy."""

from __future__ import annotations

import numpy as np


def fit_logistic(starts: np.ndarray, index: np.ndarray, value: np.ndarray, target: np.ndarray, dim: int,
                 l2: float = 1e-5, steps: int = 150, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch adaptive gradient steps; `target` may hold soft labels.

    Row i owns index[starts[i]:starts[i + 1]]. The steps and their order are fixed, so the fit repeats.
    """
    rows = len(starts) - 1
    owner = np.repeat(np.arange(rows), np.diff(starts))
    w, b = np.zeros(dim), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    seen, seen_b = np.full(dim, 1e-8), 1e-8
    for _ in range(steps):
        miss = sigmoid(np.bincount(owner, weights=value * w[index], minlength=rows) + b) - target
        grad = np.bincount(index, weights=value * miss[owner], minlength=dim) / rows + l2 * w
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
        seen_b += miss.mean() ** 2
        b -= 0.1 * rate * miss.mean() / np.sqrt(seen_b)
    return w, b


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def calibrate(score: np.ndarray, target: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of Platt scaling, with smoothed targets; (1, 0) if one class is missing."""
    good, bad = target.sum(), (1 - target).sum()
    if good == 0 or bad == 0:
        return 1.0, 0.0
    goal = np.where(target > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([score, np.ones_like(score)], 1)
    for _ in range(steps):  # Newton steps with a small ridge
        p = sigmoid(x @ theta)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - goal) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - np.clip(step, -1.0, 1.0)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])
