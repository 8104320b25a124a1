"""Student-t helpers for Arrow batches (Spark SQL has no lgamma or beta)."""

from __future__ import annotations

import math

import numpy as np


def lgamma(x):
    x = np.asarray(x, float)
    if x.size <= 64:
        return np.array([math.lgamma(v) for v in x.ravel()]).reshape(x.shape)
    # Batches repeat few degrees of freedom.
    u, inv = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in u])[inv].reshape(x.shape)


def _beta_fraction(a, b, x, steps=200):
    """Continued fraction of the incomplete beta function, modified Lentz."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + coef / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def student_cdf(z, nu):
    z, nu = np.broadcast_arrays(np.asarray(z, float), np.asarray(nu, float))
    a, b = nu / 2.0, np.full_like(nu, 0.5)
    x = nu / (nu + z * z)
    front = np.exp(
        lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(np.maximum(x, 1e-300))
        + b * np.log(np.maximum(1.0 - x, 1e-300))
    )
    swap = x > (a + 1.0) / (a + b + 2.0)
    xa = np.where(swap, 1.0 - x, x)
    aa, bb = np.where(swap, b, a), np.where(swap, a, b)
    part = front * _beta_fraction(aa, bb, xa) / aa
    tail = 0.5 * np.where(swap, 1.0 - part, part)
    return np.where(z > 0, 1.0 - tail, tail)


def student_log_norm(nu):
    """log of the constant of the standard density."""
    nu = np.asarray(nu, float)
    return lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * np.log(nu * np.pi)


def student_crps(z, nu):
    """CRPS of the standard t against z, in closed form; needs nu > 1."""
    z, nu = np.broadcast_arrays(np.asarray(z, float), np.asarray(nu, float))
    pdf = np.exp(student_log_norm(nu) - 0.5 * (nu + 1) * np.log1p(z * z / nu))
    log_b = lgamma(np.full_like(nu, 0.5)) + lgamma(nu - 0.5) - lgamma(nu)
    log_b2 = 2.0 * (lgamma(np.full_like(nu, 0.5)) + lgamma(nu / 2) - lgamma((nu + 1) / 2))
    return (
        z * (2.0 * student_cdf(z, nu) - 1.0)
        + 2.0 * pdf * (nu + z * z) / (nu - 1.0)
        - 2.0 * np.sqrt(nu) / (nu - 1.0) * np.exp(log_b - log_b2)
    )


def _psi_tail(x, order):
    """digamma (order 0) or trigamma (order 1) for x >= 8, by the asymptotic series."""
    i = 1.0 / (x * x)
    if order == 0:
        return np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))
    return 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * 5 / 66))))


def psi(x, order: int = 0):
    """digamma or trigamma of positive numbers."""
    x = np.asarray(x, float).copy()
    total = np.zeros_like(x)
    while (low := x < 8).any():
        total += np.where(low, -1.0 / x if order == 0 else 1.0 / (x * x), 0.0)
        x = np.where(low, x + 1.0, x)
    return total + _psi_tail(x, order)


def student_log_norm_slopes(nu):
    """First and second derivative of student_log_norm."""
    nu = np.asarray(nu, float)
    first = 0.5 * (psi((nu + 1) / 2) - psi(nu / 2) - 1 / nu)
    second = 0.25 * (psi((nu + 1) / 2, 1) - psi(nu / 2, 1)) + 0.5 / (nu * nu)
    return first, second
