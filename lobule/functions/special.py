"""Distribution functions in plain Python, for the few numbers that remain after aggregation."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def f_tail(f: float | None, d1: float, d2: float) -> float | None:
    """P(F > f)."""
    if f is None or not (d1 > 0 and d2 > 0) or math.isnan(f):
        return None
    return 1.0 if f <= 0 else 0.0 if math.isinf(f) else beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float | None, df: float) -> float | None:
    if t is None or not df > 0 or math.isnan(t):
        return None
    return 0.0 if math.isinf(t) else beta_share(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def t_quantile(p: float, df: float) -> float:
    """x with P(T <= x) = p, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


@lru_cache(4)
def _legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


_erf = np.vectorize(math.erf)


def range_tail(q: float | None, k: int, df: float) -> float | None:
    """P(studentized range of k means > q) with df degrees of freedom, by Gauss-Legendre quadrature over both integrals."""
    if q is None or k < 2 or not df > 0 or math.isnan(q):
        return None
    if q <= 0:
        return 1.0
    x, w = _legendre(64)
    z, wz = 8 * x, 8 * w
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def inner(width: float) -> float:
        gap = (_erf(z / math.sqrt(2)) - _erf((z - width) / math.sqrt(2))) / 2
        return float(k * (wz * density * gap ** (k - 1)).sum())

    if df > 1e5:
        return max(0.0, 1 - inner(q))
    spread = 1 / math.sqrt(2 * df)
    low, high = max(1e-9, 1 - 10 * spread), 1 + 10 * spread
    s, ws = (low + high) / 2 + (high - low) / 2 * x, (high - low) / 2 * w
    log_density = df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    inside = float((ws * np.exp(log_density) * np.array([inner(q * v) for v in s])).sum())
    return min(1.0, max(0.0, 1 - inside))


def range_quantile(p: float, k: int, df: float) -> float:
    """q with P(range <= q) = p, by bisection."""
    low, high = 0.0, 8.0
    while 1 - range_tail(high, k, df) < p:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - range_tail(mid, k, df) < p else (low, mid)
    return (low + high) / 2
