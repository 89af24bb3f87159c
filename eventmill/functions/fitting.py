"""Small fits of histograms: bounded least squares, non-negative shares, normal probabilities. A histogram has 1024 bins at most."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

_GRID = np.linspace(-9.0, 9.0, 36_001)
_CDF = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in _GRID])


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """To nine digits, from a table."""
    return np.interp(x, _GRID, _CDF)


def deviance_residuals(expected: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signed roots of each bin's part of the Poisson deviance."""
    e = np.maximum(expected, 1e-10)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = e - counts + np.where(counts > 0, counts * np.log(counts / e), 0.0)
    return np.sign(e - counts) * np.sqrt(2 * np.maximum(part, 0.0))


def nonnegative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 for which a @ x is nearest to b, by an active set."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-12 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(6 * n + 6):
        pull = a.T @ (b - a @ x)
        pull[free] = -np.inf
        if pull.max(initial=-np.inf) <= tolerance:
            break
        free[pull.argmax()] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                x = z
                break
            # as far as all stay above zero; what reaches it leaves
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            free &= x > 1e-14
            x[~free] = 0.0
    return x


def shares(parts: np.ndarray, counts: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Non-negative numbers of events of each part (rows: probabilities of bins), each bin by its Poisson variance."""
    expected = np.maximum(counts, 1.0)
    w = np.zeros(len(parts))
    for _ in range(rounds):
        scale = 1 / np.sqrt(np.maximum(expected, 1.0))
        w = nonnegative((parts * scale).T, counts * scale)
        expected = w @ parts
    return w


def bounded_least_squares(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, bool]:
    """Damped Gauss-Newton steps inside bounds; the place and whether it is settled.

    A parameter at a bound that the step would leave rests in that step.
    """
    x = np.clip(start, low, high)
    span = np.where(np.isfinite(high - low), high - low, np.maximum(np.abs(x), 1.0))
    r = residual(x)
    cost, damping = float(r @ r), 1e-3
    for _ in range(rounds):
        jacobian = np.empty((len(r), len(x)))
        for k in range(len(x)):
            h = 1e-5 * span[k] * (1 if x[k] + 1e-5 * span[k] <= high[k] else -1)
            moved = x.copy()
            moved[k] += h
            jacobian[:, k] = (residual(moved) - r) / h
        slope = jacobian.T @ r
        moves = ~(((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0)))
        if not moves.any():
            return x, True
        normal = jacobian[:, moves].T @ jacobian[:, moves]
        while True:
            step = np.zeros(len(x))
            step[moves] = -np.linalg.lstsq(normal + damping * np.diag(np.maximum(np.diag(normal), 1e-12)), slope[moves], rcond=None)[0]
            tried = np.clip(x + step, low, high)
            t = residual(tried)
            if float(t @ t) < cost:
                break
            damping *= 4
            if damping > 1e12:
                return x, True
        gained, small = cost - float(t @ t), np.abs(tried - x).max() < 1e-9 * span.max()
        x, r, cost, damping = tried, t, float(t @ t), max(damping / 6, 1e-12)
        if gained < 1e-9 * max(cost, 1.0) or small:
            return x, True
    return x, False
