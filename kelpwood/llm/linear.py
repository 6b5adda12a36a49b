"""Small linear models fitted on the driver from bounded samples: squared-hinge SVM and logistic regression."""

from __future__ import annotations

import numpy as np


def _descend(grad, dim: int, smooth: float, rounds: int) -> np.ndarray:
    """Nesterov's accelerated descent with a fixed step (the loss is convex and its gradient ``smooth``-Lipschitz)."""
    w, y, t = np.zeros(dim), np.zeros(dim), 1.0
    for _ in range(rounds):
        new = y - grad(y) / smooth
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def _balance(y: np.ndarray) -> np.ndarray:
    """Weights under which both classes count alike; rows with y = 0 don't count."""
    pos = max(1, int((y > 0).sum()))
    neg = max(1, int((y < 0).sum()))
    return np.where(y > 0, 0.5 / pos, np.where(y < 0, 0.5 / neg, 0.0))


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]


def _pull(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """c times x with a column of ones behind it, without making that matrix."""
    return np.append(c.astype(x.dtype) @ x, c.sum())


def _norm(x: np.ndarray, weight: np.ndarray) -> float:
    v, s = np.ones(x.shape[1] + 1), 1.0
    for _ in range(8):
        v = _pull(x, weight * _margin(x, v))
        s = float(np.linalg.norm(v)) or 1.0
        v /= s
    return 1.2 * s


def fit_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights (the last one: intercept) of a linear SVM with squared hinge loss; y: +1, -1, or 0 for rows that don't count."""
    weight = _balance(y)

    def grad(w):
        slack = np.maximum(0, 1 - y * _margin(x, w))
        return _pull(x, -2 * weight * y * slack) + l2 * w

    return _descend(grad, x.shape[1] + 1, 2 * _norm(x, weight) + l2, rounds)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-5, rounds: int = 200) -> np.ndarray:
    """Weights (the last one: intercept) of a logistic regression; y: +1 or -1."""
    weight = np.full(len(y), 1 / max(1, len(y)))

    def grad(w):
        return _pull(x, -weight * y / (1 + np.exp(np.clip(y * _margin(x, w), -30, 30)))) + l2 * w

    return _descend(grad, x.shape[1] + 1, 0.25 * _norm(x, weight) + l2, rounds)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into log-odds."""
    scale = float(np.abs(margin).mean()) or 1.0
    w = fit_logistic((margin / scale)[:, None], y, l2=1e-3, rounds=200)
    return float(w[0] / scale), float(w[1])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
