"""Special functions: log-gamma as a Column, distribution functions for the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Lanczos approximation of the gamma function, g = 7
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma_col(x: Column) -> Column:
    """log of the gamma function for x > 0; below one half through x + 1."""
    small = x < 0.5
    z = F.when(small, x).otherwise(x - 1.0)
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + float(k))
    t = z + 7.5
    out = F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)
    return F.when(small, out - F.log(x)).otherwise(out)


def lgamma_np(x: np.ndarray) -> np.ndarray:
    """lgamma_col() of an array."""
    small = x < 0.5
    z = np.where(small, x, x - 1.0)
    total = LANCZOS[0] + sum(c / (z + k) for k, c in enumerate(LANCZOS[1:], 1))
    t = z + 7.5
    out = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(total)
    return np.where(small, out - np.log(x), out)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of normal_cdf by bisection and Newton steps."""
    if not 0 < p < 1:
        return math.inf if p >= 1 else -math.inf
    low, high = -40.0, 40.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - front * h)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            part = 1.0
        elif i % 2 == 0:
            part = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            part = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + part * d or 1e-300)
        c = 1 + part / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-16:
            break
    return min(1.0, front * (f - 1))


def chi2_sf(x: float, df: float) -> float:
    """Probability that a chi-squared variable exceeds x."""
    return 1.0 if x <= 0 or df <= 0 else max(0.0, 1 - gamma_p(df / 2, x / 2))


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of Student's t; normal above 1000 degrees of freedom."""
    if df > 1000:
        return 2 * normal_cdf(-abs(t))
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    """Probability that an F variable exceeds f."""
    return 1.0 if f <= 0 or d1 <= 0 or d2 <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))
