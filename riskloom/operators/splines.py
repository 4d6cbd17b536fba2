"""Spline bases as Columns: B-splines, natural splines, monotone splines, difference penalties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.prefix import finite
from riskloom.operators.quantiles import floor_rank

#: Knots closer than this make an empty span.
KNOT_TOL = 1e-10


def bounds(df: DataFrame, x: Column) -> tuple[float, float]:
    v = x.cast("double")
    return tuple(df.filter(finite(v)).agg(F.min(v), F.max(v)).first())


def bs_knots(df: DataFrame, x: Column, n: int, degree: int = 3, boundary: tuple[float, float] | None = None, interior: list[float] | None = None) -> list[float]:
    """Clamped knots of n basis functions: n - degree - 1 interior ones at floor-rank quantiles, unless given."""
    low, high = boundary or bounds(df, x)
    if interior is None:
        k = max(0, n - degree - 1)
        interior = floor_rank(df, x, [(i + 1) / (k + 1) for i in range(k)]) if k else []
    return [low] * (degree + 1) + list(interior) + [high] * (degree + 1)


def bs_basis(x: Column, knots: list[float], degree: int = 3) -> list[Column]:
    """All B-spline functions by the Cox-de Boor recursion, unrolled; the last span that isn't empty is closed, outside all are 0."""
    v = x.cast("double")
    spans = len(knots) - 1
    wide = [i for i in range(spans) if knots[i + 1] - knots[i] >= KNOT_TOL]
    level: list[Column | None] = []
    for i in range(spans):
        if i not in wide:
            level.append(None)
            continue
        inside = (v >= knots[i]) & ((v <= knots[i + 1]) if i == wide[-1] else (v < knots[i + 1]))
        level.append(F.when(inside, 1.0).otherwise(0.0))
    for k in range(1, degree + 1):
        nxt: list[Column | None] = []
        for i in range(spans - k):
            parts = []
            if level[i] is not None and knots[i + k] - knots[i] >= KNOT_TOL:
                parts.append((v - knots[i]) / (knots[i + k] - knots[i]) * level[i])
            if level[i + 1] is not None and knots[i + k + 1] - knots[i + 1] >= KNOT_TOL:
                parts.append((knots[i + k + 1] - v) / (knots[i + k + 1] - knots[i + 1]) * level[i + 1])
            nxt.append(parts[0] + parts[1] if len(parts) == 2 else parts[0] if parts else None)
        level = nxt
    return [F.lit(0.0) if c is None else c for c in level]


def bs_basis_np(x: np.ndarray, knots: list[float], degree: int = 3) -> np.ndarray:
    """bs_basis() of an array."""
    t = np.asarray(knots, float)
    spans = len(t) - 1
    wide = np.nonzero(np.diff(t) >= KNOT_TOL)[0]
    b = np.zeros((spans, len(x)))
    for i in wide:
        b[i] = (x >= t[i]) & ((x <= t[i + 1]) if i == wide[-1] else (x < t[i + 1]))
    for k in range(1, degree + 1):
        for i in range(spans - k):
            left = (x - t[i]) / (t[i + k] - t[i]) * b[i] if t[i + k] - t[i] >= KNOT_TOL else 0.0
            right = (t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) * b[i + 1] if t[i + k + 1] - t[i + 1] >= KNOT_TOL else 0.0
            b[i] = left + right
    return b[: spans - degree].T


def ns_knots(df: DataFrame, x: Column, n: int, boundary: tuple[float, float] | None = None, interior: list[float] | None = None) -> list[float]:
    """Boundary and n - 1 interior knots of a natural spline."""
    low, high = boundary or bounds(df, x)
    if interior is None:
        k = max(0, n - 1)
        interior = floor_rank(df, x, [(i + 1) / (k + 1) for i in range(k)]) if k else []
    return [low, *interior, high]


def ns_basis(x: Column, knots: list[float], n_columns: int) -> list[Column]:
    """x above the first knot, then differences of truncated cubes that are linear beyond the last knot."""
    v = x.cast("double")
    last = knots[-1]

    def cube(knot: float) -> Column:
        d = F.greatest(v - knot, F.lit(0.0))
        return d * d * d

    def scaled(knot: float) -> Column:
        return F.lit(0.0) if abs(last - knot) < KNOT_TOL else (cube(knot) - cube(last)) / (last - knot)

    out = [v - knots[0]] + [scaled(k) - scaled(knots[-2]) for k in knots[:-2]]
    return (out + [F.lit(0.0)] * n_columns)[:n_columns]


def ns_basis_np(x: np.ndarray, knots: list[float], n_columns: int) -> np.ndarray:
    """ns_basis() of an array."""
    last = knots[-1]
    cube = lambda k: np.maximum(x - k, 0.0) ** 3
    scaled = lambda k: np.zeros_like(x) if abs(last - k) < KNOT_TOL else (cube(k) - cube(last)) / (last - k)
    out = [x - knots[0]] + [scaled(k) - scaled(knots[-2]) for k in knots[:-2]]
    return np.column_stack((out + [np.zeros_like(x)] * n_columns)[:n_columns])


def is_basis(x: Column, knots: list[float], degree: int = 3, increasing: bool = True) -> list[Column]:
    """Monotone functions between 0 and 1: sums of B-splines from the right; reversed and flipped if decreasing."""
    v = x.cast("double")
    basis = bs_basis(x, knots, degree)
    out, total = [], F.lit(0.0)
    for b in reversed(basis):
        total = total + b
        out.append(F.when(v <= knots[0], 0.0).when(v >= knots[-1], 1.0).otherwise(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0))))
    out.reverse()
    return out if increasing else [1.0 - c for c in reversed(out)]


def bs_names(x: str, n: int) -> list[str]:
    return [f"bs({x}, {i}/{n})" for i in range(2, n + 1)]


def ns_names(x: str, n: int) -> list[str]:
    return [f"ns({x}, {i}/{n})" for i in range(1, n)]


def is_names(x: str, n: int) -> list[str]:
    return [f"is({x}, {i}/{n})" for i in range(1, n + 1)]


def smooth_names(x: str, n: int, sign: str = "") -> list[str]:
    return [f"bs({x}, {i}/{n}, {n}{', ' + sign if sign else ''})" for i in range(2, n + 1)]


def difference_matrix(n: int, order: int = 2) -> np.ndarray:
    return np.diff(np.eye(n), order, axis=0)


def penalty_matrix(n: int, order: int = 2) -> np.ndarray:
    """D'D of the differences of neighbouring coefficients."""
    d = difference_matrix(n, order)
    return d.T @ d
