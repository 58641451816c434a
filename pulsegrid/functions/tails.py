"""Tail probabilities and critical values for result tables (NumPy only)."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def beta_cdf(a, b, x) -> np.ndarray:
    a, b, x = np.broadcast_arrays(
        np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0.0, 1.0)
    )
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)
        )
        swap = x > (a + 1.0) / (a + b + 2.0)
        aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
        part = front * _beta_fraction(aa, bb, xx) / aa
    out = np.where(swap, 1.0 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.where(np.isfinite(t), beta_cdf(df / 2.0, 0.5, df / (df + t * t)), np.nan)


def t_cdf(t, df) -> np.ndarray:
    half = t_two_sided(t, df) / 2.0
    return np.where(np.asarray(t, float) >= 0, 1.0 - half, half)


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return np.where(np.isfinite(f), beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)), np.nan)


def t_critical(df, level: float = 0.95) -> np.ndarray:
    """Two-sided critical value by bisection on the tail."""
    df = np.asarray(df, float)
    low, high = np.zeros_like(df), np.full_like(df, 1e4)
    for _ in range(80):
        mid = (low + high) / 2.0
        wide = t_two_sided(mid, df) > 1.0 - level
        low, high = np.where(wide, mid, low), np.where(wide, high, mid)
    return (low + high) / 2.0

