"""Exploration before a fit: response, factors, association, collinearity, missing values."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.factors import level
from riskloom.operators.prefix import finite
from riskloom.operators.quantiles import band, linear, unique_edges


def response_stats(df: DataFrame, y: Column, exposure: Column) -> DataFrame:
    """n, sums, mean and std of the rate, zeros, interpolated percentiles of y per exposure."""
    rate = y / exposure
    names = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    out = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(exposure.cast("double")).alias("exposure"), F.sum(y.cast("double")).alias("total"), F.avg(rate).alias("mean_rate"),
        F.stddev_pop(rate).alias("std_rate"), F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"), F.count(F.when(y == 0, 1)).alias("zeros"),
    )
    found = linear(df, rate, list(names.values())) or [None] * len(names)
    out = out.withColumns({k: F.lit(v).cast("double") for k, v in zip(names, found, strict=True)})
    return out.withColumn("zero_pct", 100.0 * F.col("zeros") / F.col("n"))


def continuous_table(df: DataFrame, x: Column, y: Column, exposure: Column, n_bins: int = 10, thin_pct: float = 1.0) -> DataFrame:
    """Rates by percentile bins of x, with thin cells marked."""
    v = x.cast("double")
    edges = unique_edges(linear(df, v, [k / n_bins for k in range(n_bins + 1)]))
    rows = df.filter(finite(v)).withColumn("_bin", F.least(band(v, edges[1:-1]), F.lit(max(0, len(edges) - 2))))
    out = rows.groupBy(F.col("_bin").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("x_min"), F.max(v).alias("x_max"), F.sum(exposure).alias("exposure"), F.sum(y).alias("actual"), (F.sum(y) / F.sum(exposure)).alias("rate")
    )
    share = 100 * F.col("exposure") / F.sum("exposure").over(Window.partitionBy())
    return out.withColumn("is_thin", share < thin_pct)


def shape_hint(rates: list[float]) -> str:
    """Flat, monotone, u_shaped or irregular, from rates in order of x."""
    if len(rates) < 3:
        return "too_few"
    spread, mean = max(rates) - min(rates), sum(rates) / len(rates)
    if mean == 0 or spread / abs(mean) < 0.1:
        return "flat"
    steps = [b - a for a, b in zip(rates, rates[1:], strict=False)]
    if all(s >= 0 for s in steps) or all(s <= 0 for s in steps):
        return "monotone"
    signs = [s > 0 for s in steps if s]
    return "u_shaped" if sum(a != b for a, b in zip(signs, signs[1:], strict=False)) == 1 else "irregular"


def weighted_correlation(df: DataFrame, x: Column, y: Column, exposure: Column) -> DataFrame:
    """Exposure-weighted correlation of x with y/exposure and its F statistic."""
    v, r, w = x.cast("double"), y / exposure, exposure.cast("double")
    rows = df.filter(finite(v)).select(v.alias("v"), r.alias("r"), w.alias("w"))
    s = rows.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("x"), F.sum(F.col("w") * F.col("r")).alias("y"), F.sum(F.expr("w*v*v")).alias("xx"), F.sum(F.expr("w*r*r")).alias("yy"), F.sum(F.expr("w*v*r")).alias("xy"), F.count(F.lit(1)).alias("n"))
    cov = F.expr("xy/w - (x/w)*(y/w)")
    var = F.expr("(xx/w - (x/w)*(x/w)) * (yy/w - (y/w)*(y/w))")
    out = s.select("n", F.when(var > 0, cov / F.sqrt(var)).otherwise(0.0).alias("correlation"))
    r2 = F.col("correlation") * F.col("correlation")
    return out.withColumn("r2", r2).withColumn("f_statistic", F.when(r2 < 1, r2 / ((1 - r2) / (F.col("n") - 2))).otherwise(float("inf")))


def correlation_matrix(df: DataFrame, columns: list[str], moderate: float = 0.7, high: float = 0.9) -> DataFrame:
    """Pearson correlation of each pair over rows where both are finite; all pairs in one pass."""
    pairs = list(combinations(columns, 2))
    each = []
    for k, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        good = finite(x) & finite(y)
        each.append(F.corr(F.when(good, x), F.when(good, y)).alias(f"c{k}"))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)])
    out = df.agg(*each).select(F.explode(rows).alias("r")).select("r.*")
    size = F.abs(F.col("correlation"))
    return out.withColumn("severity", F.when(size > high, "high").when(size > moderate, "moderate").otherwise("none"))


def correlation_array(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """Correlations over complete rows as one array, from one pass of centred moments."""
    vs = [c.cast("double") for c in columns]
    good = vs[0].isNotNull()
    for v in vs:
        good = good & finite(v)
    p = len(vs)
    rows = df.filter(good)
    flat = rows.agg(*[F.covar_pop(vs[i], vs[j]) for i in range(p) for j in range(i, p)]).first()
    out, at = np.eye(p), iter(flat)
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = next(at) or 0.0
    d = np.sqrt(np.maximum(np.diag(out), 0))
    d[d == 0] = 1.0
    return out / np.outer(d, d)


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation of each column against the others, largest first (rank 1): the diagonal of the inverse correlation."""
    corr = correlation_array(df, [F.col(c) for c in columns])
    values = np.diag(np.linalg.inv(corr + 1e-10 * np.eye(len(columns))))
    grade = lambda v: "severe" if v > 10 else "moderate" if v > 5 else "none"
    rows = sorted(((c, float(v), grade(v)) for c, v in zip(columns, values, strict=True)), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame([(*r, k + 1) for k, r in enumerate(rows)], "factor string, vif double, severity string, rank long")


# fixed values: scales whose names have an order
SCALES = {"low_medium_high": ("low", "medium", "high"), "size": ("small", "medium", "large"), "age": ("young", "middle", "old")}


def ordinal_pattern(df: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, pattern) of factors: numeric, alphabetic, one of SCALES, prefix_numeric, or null if the levels have no order; one pass."""
    name = level(F.col("c.v"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("v")) for f in factors]))
    levels = df.select(cells.alias("c")).select(F.col("c.factor").alias("factor"), name.alias("v")).distinct()
    every = lambda c: F.every(F.coalesce(c, F.lit(False)))
    v = F.col("v")
    out = levels.groupBy("factor").agg(
        every(v.try_cast("double").isNotNull()).alias("numeric"),
        every(v.rlike(r"^\p{L}$")).alias("alphabetic"),
        *[(F.count_distinct(F.when(F.lower(v).isin(*own), F.lower(v))) == len(own)).alias(k) for k, own in SCALES.items()],
        every(v.rlike(r"^[A-Za-z]+[0-9]+$")).alias("prefix_numeric"),
    )
    pattern = F.lit(None).cast("string")
    for k in reversed(("numeric", "alphabetic", *SCALES, "prefix_numeric")):
        pattern = F.when(F.col(k), k).otherwise(pattern)
    return out.select("factor", pattern.alias("pattern"))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls (NaN among doubles) per column, and complete rows."""
    kinds = dict(df.dtypes)
    null = {c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull() for c in columns}
    complete = F.lit(True)
    for c in columns:
        complete = complete & ~null[c]
    total = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(complete, 1)).alias("complete_rows"), *[F.count(F.when(null[c], 1)).alias(f"m{k}") for k, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"m{k}").alias("missing")) for k, c in enumerate(columns)])
    out = total.select("n", "complete_rows", F.explode(rows).alias("r")).select("r.*", "n", "complete_rows")
    pct = 100.0 * F.col("missing") / F.col("n")
    return out.select("name", "missing", pct.alias("pct"), F.when(pct > 10, "high").when(pct > 1, "moderate").otherwise("low").alias("severity"), "complete_rows")


def cramers_v(df: DataFrame, columns: list[str]) -> DataFrame:
    """Association of each pair of factors; all pairs in one explode and one count per cell.

    chi-squared is n (sum o^2/(row*column) - 1), so that cells without rows need no place.
    """
    pairs = list(combinations(range(len(columns)), 2))
    names = [level(F.col(c)) for c in columns]
    cell = F.explode(F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), names[i].alias("x"), names[j].alias("y")) for i, j in pairs]))
    o = df.select(cell.alias("c")).select("c.*").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("o"))
    rows = o.groupBy("a", "b", "x").agg(F.sum("o").alias("r"))
    cols = o.groupBy("a", "b", "y").agg(F.sum("o").alias("c"))
    part = o.join(rows, ["a", "b", "x"]).join(cols, ["a", "b", "y"])
    s = part.groupBy("a", "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c")).cast("double")).alias("s"), F.sum("o").alias("n"))
    shape = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("kr")).join(cols.groupBy("a", "b").agg(F.count(F.lit(1)).alias("kc")), ["a", "b"])
    out = s.join(shape, ["a", "b"])
    least = F.least("kr", "kc") - 1
    v = F.when(least > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / least)).otherwise(0.0)
    out = out.select("a", "b", v.alias("v"), F.col("n").cast("long").alias("n"))
    return out.withColumn("severity", F.when(F.col("v") > 0.5, "high").when(F.col("v") > 0.3, "moderate").otherwise("none"))


def design_check(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Per design column NaN, infinite and variance counts, and what of it should be changed."""
    aggregates = []
    for k, c in enumerate(columns.values()):
        v = c.cast("double")
        good = F.when(finite(v), v)
        aggregates += [F.count(F.when(F.isnan(v) | v.isNull(), 1)).alias(f"a{k}"), F.count(F.when(F.abs(v) == float("inf"), 1)).alias(f"b{k}"), F.var_pop(good).alias(f"v{k}")]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"a{k}").alias("n_nan"), F.col(f"b{k}").alias("n_inf"), F.col(f"v{k}").alias("variance")) for k, n in enumerate(columns)])
    out = df.agg(*aggregates).select(F.explode(rows).alias("r")).select("r.*")
    problem = F.when((F.col("n_nan") > 0) | (F.col("n_inf") > 0), "not finite").when((F.col("variance") < 1e-10) & (F.col("name") != "Intercept"), "constant")
    return out.withColumn("problem", F.coalesce(problem, F.lit("none")))
