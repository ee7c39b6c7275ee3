"""Tail probabilities one number at a time, by finite sums, a forward continued fraction and the math module: what the column expressions are held against."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny) * (1 if 1.0 - (a + b) * x / (a + 1.0) > 0 else -1)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function; the prefactor is taken in logarithms, so tiny tails keep their digits."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_two_sided(t: float, df: float) -> float:
    if df <= 0:
        return math.nan
    return 1.0 if t == 0 else beta_cdf(df / (df + t * t), df / 2, 0.5)


def chi2_upper(x: float, df: float) -> float:
    """Upper tail for whole degrees of freedom, by the finite sums."""
    if x <= 0:
        return 1.0
    k, half = int(df), x / 2
    if k % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    term, total = math.sqrt(half) * 2 / math.sqrt(math.pi), 0.0
    for i in range(1, (k - 1) // 2 + 1):
        total += term
        term *= half / (i + 0.5)
    return math.erfc(math.sqrt(half)) + math.exp(-half) * total


def t_inverse(p: float, df: float) -> float:
    """Quantile for p over one half, by bisection on the two-sided tail."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2
