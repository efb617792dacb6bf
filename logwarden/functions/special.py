"""Tails of the Beta and Poisson distributions, in numpy on arrays."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction."""
    x, a, b = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(x, a, b))
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    if not inside.any():
        return out
    x, a, b = x[inside], a[inside], b[inside]
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    value = front * h
    out[inside] = np.where(swap, 1 - value, value)
    return np.clip(out, 0.0, 1.0)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The p-quantile of Beta(a, b), by bisection."""
    p, a, b = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(p, a, b))
    low, high = np.zeros_like(p), np.ones_like(p)
    for _ in range(60):
        middle = (low + high) / 2
        below = beta_cdf(middle, a, b) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def poisson_tail(value: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """P(X > floor(value)) for a Poisson variable; 1 where the rate is not positive."""
    value, rate = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(value, rate))
    out = np.ones_like(rate)
    for n in np.flatnonzero(rate > 0):
        k, r = math.floor(value[n]), rate[n]
        if k < 0:
            continue
        if k < r:  # sum up to k, else the terms above it, both in log space from the largest
            i = np.arange(k, max(-1, k - 400 - int(40 * math.sqrt(r))), -1)
            out[n] = 1 - np.exp(i * math.log(r) - r - _lgamma(i + 1.0)).sum()
        else:
            i = np.arange(k + 1, k + 401 + int(40 * math.sqrt(r)))
            out[n] = np.exp(i * math.log(r) - r - _lgamma(i + 1.0)).sum()
    return np.clip(out, 0.0, 1.0)
