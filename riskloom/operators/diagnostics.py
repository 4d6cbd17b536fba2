"""Diagnostics of designs and of terms that a model has or lacks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.errors import LinearAlgebraError
from riskloom.functions.special import chi2_sf
from riskloom.operators.factors import level
from riskloom.operators.gram import packed, row_sums
from riskloom.operators.prefix import keep, released
from riskloom.plans.spec import ModelSpec

#: Variances below this are those of a constant; a design's condition number and a correlation above these are a problem.
LEAST_VARIANCE, MOST_CONDITION, MOST_CORRELATION = 1e-10, 1e10, 0.999


class Moments:
    """Of a design's columns, from one pass over its rows: counts, means, covariance, the Gram matrix."""

    def __init__(self, df: DataFrame, spec: ModelSpec):
        self.names = spec.names()
        p = len(self.names)
        x = spec.design(df).select(F.col("_x").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(0.0).alias("o"))
        first = x.select("x").first()
        shift = np.nan_to_num(np.array(first[0] if first else [0.0] * p, float), posinf=0.0, neginf=0.0)  # near the means, against cancellation

        def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, o: np.ndarray) -> np.ndarray:
            nan, inf = np.isnan(x).sum(axis=0), np.isinf(x).sum(axis=0)
            whole = x[np.isfinite(x).all(axis=1)]
            d = whole - shift
            return packed(d.T @ d, d.sum(axis=0), float(len(whole)), nan, inf)

        out = row_sums(x, sums, p * p + 3 * p + 1)
        square, total, n = out[: p * p].reshape(p, p), out[p * p : p * p + p], out[p * p + p]
        self.nan, self.inf = (out[p * p + p + 1 + k * p : p * p + p + 1 + (k + 1) * p].astype(int) for k in (0, 1))
        self.n = int(n)
        mean = total / max(n, 1.0)
        self.covariance = square / max(n, 1.0) - np.outer(mean, mean)
        self.mean = mean + shift
        self.gram = n * (self.covariance + np.outer(self.mean, self.mean))

    def correlation(self, columns: list[int]) -> np.ndarray:
        c = self.covariance[np.ix_(columns, columns)]
        d = np.sqrt(np.maximum(np.diag(c), 0.0))
        d[d == 0] = 1.0
        return c / np.outer(d, d)


def base_variable(column: str) -> str:
    """The variable that a design column is made of; of a product, the first factor's."""
    name = column.split(":")[0].strip()
    for opening in ("pos(", "neg(", "I(", "bs(", "ns(", "TE(", "FE("):
        if name.startswith(opening):
            inner = name[len(opening) :].split(",")[0].rstrip(")")
            return base_variable(inner) if opening in ("pos(", "neg(") else inner.split("**")[0].split("*")[0].strip()
    return name.split("[")[0]


def design_vif(df: DataFrame, spec: ModelSpec) -> list[dict]:
    """Variance inflation of each design column but the intercept, largest first.

    Severity is "expected" where all columns that go along with a column are made of the same variable.
    """
    m = Moments(df, spec)
    own = [k for k, n in enumerate(m.names) if n != "Intercept"]
    if len(own) < 2:
        return [{"feature": m.names[k], "vif": 1.0, "severity": "none", "collinear_with": []} for k in own]
    corr = m.correlation(own)
    try:
        values = np.diag(np.linalg.inv(corr + LEAST_VARIANCE * np.eye(len(own))))
    except np.linalg.LinAlgError as e:
        raise LinearAlgebraError("the design is singular: duplicate or constant columns") from e
    out = []
    for i, k in enumerate(own):
        along = sorted((j for j in range(len(own)) if j != i and abs(corr[i, j]) > 0.5), key=lambda j: -abs(corr[i, j]))[:3]
        vif = float(values[i]) if math.isfinite(values[i]) else 999.0
        severity = "severe" if vif > 10 else "moderate" if vif > 5 else "none"
        if severity != "none" and along and {base_variable(m.names[own[j]]) for j in along} == {base_variable(m.names[k])}:
            severity = "expected"
        out.append({"feature": m.names[k], "vif": vif, "severity": severity, "collinear_with": [m.names[own[j]] for j in along]})
    return sorted(out, key=lambda r: -r["vif"])


def design_report(df: DataFrame, spec: ModelSpec) -> dict:
    """Whether a design can be fitted: rank, condition number, constant and near-equal columns, and what to do about them."""
    m = Moments(df, spec)
    p = len(m.names)
    d = np.sqrt(np.maximum(np.diag(m.gram), 1e-300))
    scaled = np.linalg.eigvalsh(m.gram / np.outer(d, d))
    rank = int((scaled > 1e-11 * max(scaled.max(), 0.0)).sum())
    plain = np.linalg.eigvalsh(m.gram)
    condition = math.sqrt(plain.max() / plain.min()) if rank == p and plain.min() > 0 else math.inf
    constant = [n for n, v in zip(m.names, np.diag(m.covariance), strict=True) if v < LEAST_VARIANCE and n != "Intercept"]
    moving = [k for k, v in enumerate(np.diag(m.covariance)) if v >= LEAST_VARIANCE]
    corr = m.correlation(moving)
    alike = [(m.names[a], m.names[b], float(abs(corr[i, j]))) for i, a in enumerate(moving) for j, b in enumerate(moving) if i < j and abs(corr[i, j]) > MOST_CORRELATION]
    bad = {kind: [n for n, c in zip(m.names, counts, strict=True) if c] for kind, counts in (("NaN", m.nan), ("infinite", m.inf))}
    todo = [f"{kind} values in {', '.join(names)}: clean or drop these rows" for kind, names in bad.items() if names]
    if constant:
        todo.append(f"no variance in {', '.join(constant)}: drop these columns; splines of skewed data often have such, fewer degrees of freedom help")
    if rank < p:
        todo.append(f"rank {rank} of {p}: {p - rank} columns follow from others; drop or merge levels or terms")
    if condition > MOST_CONDITION:
        todo.append(f"condition number {condition:.2e}: scale the variables or drop nearly dependent columns")
    todo += [f"{a} and {b} correlate at {r:.4f}: keep one, or use B-splines or fewer degrees of freedom" for a, b, r in alike]
    return {"valid": not todo, "n": m.n, "rank": rank, "expected_rank": p, "condition_number": condition, "constant": constant, "alike": alike, "suggestions": todo}


def _working(model, df: DataFrame) -> DataFrame:
    """df with the design in _x, the working weight in _w and the score's weight in _u, so that the score of z is the sum of _u*z."""
    scored = model.eta(df).withColumn("_mu", model.family.clamp(model.link.inverse(F.col("_eta"))))
    g, v = model.link.slope(F.col("_mu")), model.family.variance(F.col("_mu"))
    w = (F.lit(1.0) if model.weights is None else F.col(model.weights)) / (v * g * g)
    y = F.col(model.spec.response).cast("double")
    return scored.withColumns({"_w": w, "_u": w * g * (y - F.col("_mu"))})


def score_test_levels(model, df: DataFrame, factor: Column) -> dict:
    """Rao test of a factor that the model lacks, with a degree of freedom for each level but the first.

    One aggregate by level gives the scores, the weights and their products with the design; the driver
    holds a row per level.
    """
    p = len(model.names)
    rows = _working(model, df).groupBy(level(factor).alias("level"))
    rows = rows.agg(F.sum("_u"), F.sum("_w"), *[F.sum(F.col("_w") * F.get("_x", F.lit(j))) for j in range(p)]).orderBy("level").collect()[1:]
    if not rows:
        return {"statistic": 0.0, "df": 0, "p_value": 1.0}
    u, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    cross = np.array([r[3:] for r in rows], float)
    info = (np.diag(w) - cross @ model.fit.cov @ cross.T) * model.scale
    try:
        stat = float(u @ np.linalg.solve(info, u))
    except np.linalg.LinAlgError:  # levels that the model's terms explain already
        stat = float(u @ np.linalg.pinv(info, hermitian=True) @ u)
    return {"statistic": max(stat, 0.0), "df": len(rows), "p_value": chi2_sf(max(stat, 0.0), len(rows))}


def score_test_encoded(model, df: DataFrame, factor: Column, exposure: Column | None = None) -> dict:
    """The same with one degree of freedom: of the levels' mean rates as a number. One aggregate by level, of which one row reaches the driver."""
    rate = F.col(model.spec.response).cast("double") / (F.lit(1.0) if exposure is None else F.greatest(exposure.cast("double"), F.lit(1e-10)))
    wx = F.array(*[F.sum(F.col("_w") * F.get("_x", F.lit(j))) for j in range(len(model.names))])
    sums = _working(model, df).groupBy(level(factor).alias("_level")).agg(F.avg(rate).alias("_z"), F.sum("_u").alias("_u"), F.sum("_w").alias("_w"), wx.alias("_wx"))
    with released():
        return model.score_of(keep(sums))


def sorted_coefficients(model) -> list[dict]:
    """The coefficient table by the size of z, the intercept last, with what a coefficient does to the mean."""
    out = []
    for r in model.coef_table():
        effect = math.exp(min(r["estimate"], 700.0)) if model.link.name in ("log", "logit") else r["estimate"]
        out.append({**r, "impact": effect, "significant": r["p_value"] < 0.05})
    return sorted(out, key=lambda r: (r["feature"] == "Intercept", -abs(r["z"])))
