"""A small logistic model fitted by Newton steps towards prior weights."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, ridge: float = 1e-2,
                 steps: int = 60) -> np.ndarray:
    """Weights (intercept first) of the maximum a posteriori logistic model; the
    Gaussian prior sits on ``prior`` (zeros if not given). Steps are halved while
    they don't improve the objective."""
    x = np.column_stack([np.ones(len(x)), x])
    centre = np.zeros(x.shape[1]) if prior is None else np.asarray(prior, float)
    w = centre.copy()

    def loss(v):
        z = np.clip(x @ v, -35, 35)
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge * ((v - centre) ** 2).sum()

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * (w - centre)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        scale = 1.0
        while scale > 1e-4 and loss(w - scale * step) > now:
            scale /= 2
        new = loss(w - scale * step)
        if now - new < 1e-9 * max(1.0, now):
            break
        w, now = w - scale * step, new
    return w
