"""Tables by factor: actual versus expected, deviance, residual patterns, partial dependence."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.families import Family, residual
from riskloom.functions.special import t_sf2
from riskloom.operators.metrics import unit_loss
from riskloom.operators.prefix import finite, ordered
from riskloom.operators.quantiles import band, linear, round_rank, unique_edges

OTHER = "_Other"


def level(c: Column, boolean: bool = False) -> Column:
    """A category's name; null is the level None."""
    text = c.cast("string")
    return F.coalesce(F.initcap(text) if boolean else text, F.lit("None"))


def _rates(table: DataFrame) -> DataFrame:
    """Means, A/E and its 95 % interval from n, exposure, actual, expected."""
    half = 1.96 * F.sqrt(F.greatest(F.col("actual"), F.lit(1.0))) / F.col("expected")
    some = F.col("expected") > 0
    return table.withColumns({
        "actual_mean": F.col("actual") / F.col("exposure"), "expected_mean": F.col("expected") / F.col("exposure"),
        "ae": F.when(some, F.col("actual") / F.col("expected")),
    }).withColumns({"ae_low": F.when(some, F.greatest(F.col("ae") - half, F.lit(0.0))), "ae_high": F.when(some, F.col("ae") + half)})


def _sums(y: Column, mu: Column, exposure: Column, loss: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.sum(exposure.cast("double")).alias("exposure"), F.sum(y.cast("double")).alias("actual"), F.sum(mu).alias("expected"),
        F.sum(unit_loss(loss, y.cast("double"), mu)).alias("_loss"),
    ]


def ae_by_level(
    df: DataFrame, factor: Column, y: Column, mu: Column, exposure: Column, rare_pct: float = 1.0, max_levels: int = 20, loss: str = "poisson"
) -> DataFrame:
    """One row per level by exposure; levels below rare_pct of it, or past the first max_levels - 1, are one level _Other."""
    each = df.groupBy(level(factor).alias("level")).agg(*_sums(y, mu, exposure, loss))
    # one row per level: the window over all of them is as large as the factor's domain
    whole, order = Window.partitionBy(), Window.orderBy(F.col("exposure").desc(), F.col("level").asc())
    ranked = each.withColumn("rank", F.row_number().over(order)).withColumn("share", 100 * F.col("exposure") / F.sum("exposure").over(whole))
    rare = (F.col("share") < rare_pct) | (F.col("rank") > max_levels - 1)
    pooled = ranked.withColumn("level", F.when(rare, F.lit(OTHER)).otherwise(F.col("level"))).groupBy("level")
    out = pooled.agg(*[F.sum(c).alias(c) for c in ("n", "exposure", "actual", "expected", "_loss")])
    return _rates(out.withColumn("loss", F.col("_loss") / F.col("n")).drop("_loss"))


def ae_by_bin(df: DataFrame, x: Column, y: Column, mu: Column, exposure: Column, n_bins: int = 10, loss: str = "poisson") -> DataFrame:
    """By bins between rounded-rank quantiles; a bin has its lower edge, the last both. Empty bins (repeated edges) are left out."""
    v = x.cast("double")
    edges = round_rank(df, v, [k / n_bins for k in range(n_bins + 1)])
    number = F.lit(None).cast("int")
    for k in reversed(range(n_bins)):
        inside = (v >= edges[k]) & ((v <= edges[k + 1]) if k == n_bins - 1 else (v < edges[k + 1]))
        number = F.when(inside, k).otherwise(number)
    rows = df.filter(finite(v)).withColumn("_bin", number).filter("_bin is not null")
    lower = F.array(*map(F.lit, edges))
    out = rows.groupBy(F.col("_bin").alias("bin")).agg(*_sums(y, mu, exposure, loss))
    out = out.withColumns({"lower": F.get(lower, F.col("bin")), "upper": F.get(lower, F.col("bin") + 1), "loss": F.col("_loss") / F.col("n")})
    return _rates(out.drop("_loss"))


def factor_deviance(df: DataFrame, factor: Column, family: Family, y: Column, mu: Column) -> DataFrame:
    """Deviance by level; a problem if its mean is over 1.5 times the whole's, A/E is off by over 0.15, or its share is twice what its rows are."""
    each = df.groupBy(level(factor).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(family.deviance(y, mu)).alias("deviance"), F.sum(y).alias("actual"), F.sum(mu).alias("expected")
    )
    whole = Window.partitionBy()
    all_dev, all_n = F.sum("deviance").over(whole), F.sum("n").over(whole)
    out = each.select(
        "level", "n", "deviance", (100 * F.col("deviance") / all_dev).alias("pct"), (F.col("deviance") / F.col("n")).alias("mean_deviance"),
        (F.col("actual") / F.col("expected")).alias("ae"), (all_dev / all_n).alias("_mean"), (100 * F.col("n") / all_n).alias("_share"),
    )
    problem = (F.col("mean_deviance") > 1.5 * F.col("_mean")) | (F.abs(F.col("ae") - 1) > 0.15) | (F.col("pct") > 2 * F.col("_share"))
    return out.withColumn("is_problem", problem).drop("_mean", "_share")


def cell_gram(df: DataFrame, first: Column, second: Column, weight: Column, z: Column) -> DataFrame:
    """What of X'WX and X'Wz the cells of two factors have, without a column for each: a row per cell that occurs.

    X'WX of cell indicators is diagonal; its entries with the levels of either factor are sums over cells.
    """
    w = weight.cast("double")
    return df.groupBy(level(first).alias("a"), level(second).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight"), F.sum(w * z.cast("double")).alias("wz"))


def level_metrics(df: DataFrame, factor: Column, family: Family, y: Column, mu: Column, exposure: Column) -> DataFrame:
    return df.groupBy(level(factor).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(exposure).alias("exposure"), (F.sum(y) / F.sum(exposure)).alias("actual_rate"), (F.sum(mu) / F.sum(exposure)).alias("predicted_rate"),
        (F.sum(y) / F.sum(mu)).alias("ae"), F.avg(residual(family, "deviance", y, mu)).alias("mean_residual"),
    )


def band_metrics(df: DataFrame, x: Column, family: Family, y: Column, mu: Column, exposure: Column, n_bands: int = 10) -> DataFrame:
    """Percentile bands (interpolated edges, repeated ones dropped) with rates, A/E and the mean prediction."""
    v = x.cast("double")
    edges = unique_edges(linear(df, v, [k / n_bands for k in range(n_bands + 1)]))
    number = F.least(band(v, edges[1:-1]), F.lit(max(0, len(edges) - 2)))
    rows = df.filter(finite(v)).withColumn("_band", number)
    at = F.array(*map(F.lit, edges if len(edges) > 1 else edges * 2))
    out = rows.groupBy(F.col("_band").alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(exposure).alias("exposure"), (F.sum(y) / F.sum(exposure)).alias("actual_rate"), (F.sum(mu) / F.sum(exposure)).alias("predicted_rate"),
        (F.sum(y) / F.sum(mu)).alias("ae"), F.avg(mu).alias("partial_dependence"), F.avg(residual(family, "deviance", y, mu)).alias("mean_residual"),
    )
    return out.withColumn("midpoint", (F.get(at, F.col("band")) + F.get(at, F.col("band") + 1)) / 2)


def continuous_stats(df: DataFrame, x: Column) -> DataFrame:
    """mean, population std, min, max, missing and rounded-rank percentiles of the finite values."""
    v = x.cast("double")
    names = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    picked = round_rank(df, v, list(names.values())) or [None] * len(names)
    good = F.when(finite(v), v)
    out = df.agg(F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"), F.min(good).alias("min"), F.max(good).alias("max"), F.count(F.when(~F.coalesce(finite(v), F.lit(False)), 1)).alias("missing"))
    return out.withColumns({k: F.lit(p).cast("double") for k, p in zip(names, picked, strict=True)})


def categorical_distribution(df: DataFrame, factor: Column, rare_pct: float = 1.0) -> DataFrame:
    each = df.groupBy(level(factor).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    out = each.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))
    return out.withColumn("is_rare", F.col("pct") < rare_pct)


def rare_levels(df: DataFrame, factor: Column, rare_pct: float = 1.0) -> DataFrame:
    """One row: levels, how many are rare, and the percentage of rows they have together."""
    rare = F.col("is_rare")
    each = categorical_distribution(df, factor, rare_pct)
    return each.agg(F.count(F.lit(1)).alias("levels"), F.count(F.when(rare, 1)).alias("rare"), F.sum(F.when(rare, F.col("pct")).otherwise(0.0)).alias("rare_pct"))


def residual_pattern_continuous(df: DataFrame, x: Column, r: Column, key: Column, n_bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row: correlation, r2, slope, p_value; mean residual of chunks of equal count by x)."""
    v = x.cast("double")
    rows = df.filter(finite(v) & finite(r)).select(v.alias("_x"), r.alias("_r"), key.alias("_key"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_r").alias("correlation"), F.regr_slope("_r", "_x").alias("slope"))
    n, corr, slope = stats.first()
    corr = corr or 0.0
    p = t_sf2(corr * ((n - 2) / max(1e-300, 1 - corr * corr)) ** 0.5, n - 2) if n > 2 else 1.0
    trend = df.sparkSession.createDataFrame([(corr, corr * corr, slope or 0.0, p)], "correlation double, r2 double, slope double, p_value double")
    size = max(1, -(-n // n_bins))
    bins = ordered(rows, [F.col("_x"), F.col("_key")]).withColumn("bin", F.floor((F.col("rn") - 1) / size).cast("int"))
    return trend, bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean_x"), F.avg("_r").alias("mean_residual"))


def eta_squared(df: DataFrame, factor: Column, value: Column, weight: Column | None = None) -> DataFrame:
    """Share of the (weighted) variance of value that lies between levels; F statistic and mean absolute level mean."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    each = df.groupBy(level(factor).alias("level")).agg(F.sum(w).alias("w"), F.sum(w * value).alias("s"), F.sum(w * value * value).alias("q"), F.count(F.lit(1)).alias("n"))
    total = each.agg(
        F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("s") * F.col("s") / F.col("w")).alias("b"), F.avg(F.abs(F.col("s") / F.col("w"))).alias("mean_abs"),
    )
    within_all = F.col("q") - F.col("s") * F.col("s") / F.col("w")
    eta = F.when(within_all > 0, (F.col("b") - F.col("s") * F.col("s") / F.col("w")) / within_all).otherwise(0.0)
    out = total.withColumn("eta_squared", eta)
    f = F.when((F.col("k") > 1) & (F.col("eta_squared") < 1), (F.col("eta_squared") / (F.col("k") - 1)) / ((1 - F.col("eta_squared")) / (F.col("n") - F.col("k"))))
    return out.select("eta_squared", F.coalesce(f, F.lit(0.0)).alias("f_statistic"), "k", "n", F.col("mean_abs").alias("mean_abs_level"))


def partial_dependence_levels(df: DataFrame, factor: Column, mu: Column) -> DataFrame:
    """Mean prediction by level, relative to the first level."""
    each = df.groupBy(level(factor).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg(mu).alias("prediction"))
    return each.withColumn("relativity", F.col("prediction") / F.first("prediction").over(Window.orderBy("level")))


def variation(predictions: list[float]) -> tuple[str, str]:
    """(class of the largest over the smallest prediction of a level, what to do)."""
    if len(predictions) < 2:
        return "single_level", "one level tells nothing"
    ratio = max(predictions) / min(predictions) if min(predictions) > 0 else float("inf")
    if ratio > 2:
        return "high_variation", "keep as a factor"
    return ("moderate_variation", "keep, or group similar levels") if ratio > 1.2 else ("low_variation", "its levels hardly differ: consider leaving it out")


def effect_shape(predictions: list[float]) -> tuple[str, str]:
    """(shape of predictions along a grid, what to do): flat, linear, monotonic, (inverted) u, steps or complex."""
    if len(predictions) < 3:
        return "insufficient_data", "more points are needed"
    steps = [b - a for a, b in zip(predictions, predictions[1:], strict=False)]
    spread, mean = max(predictions) - min(predictions), sum(predictions) / len(predictions)
    if (spread / mean if mean > 0 else 0.0) < 0.05:
        return "flat", "it may not be needed"
    bends = [abs(b - a) for a, b in zip(steps, steps[1:], strict=False)]
    straight = sum(bends) / len(bends) < 0.1 * spread
    for way, name in ((1, "increasing"), (-1, "decreasing")):
        if sum(s * way > 0 for s in steps) >= 0.8 * len(steps):
            return (f"linear_{name}", "a linear term is enough") if straight else (f"monotonic_{name}", "consider a spline")
    half = len(predictions) // 2
    left, right = (sum(x) / len(x) if x else 0.0 for x in (steps[:half], steps[half:]))
    if left * right < 0:
        return ("u_shaped" if left < 0 else "inverted_u"), "use a spline of 4 or more degrees of freedom, or a polynomial"
    if max(map(abs, steps)) > 0.4 * spread:
        return "step_function", "consider bands"
    return "complex", "use a spline of 5 or more degrees of freedom"


def interaction_strength(df: DataFrame, first: Column, second: Column, value: Column, weight: Column | None = None, least: int = 30) -> DataFrame:
    """R2 and F over cells of two discretised factors with at least `least` rows."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    cells = df.groupBy(first.alias("a"), second.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * value).alias("s"), F.sum(w * value * value).alias("q"))
    total = cells.filter(F.col("n") >= least).agg(
        F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), F.sum(F.col("s") * F.col("s") / F.col("w")).alias("b")
    )
    sst = F.col("q") - F.col("s") * F.col("s") / F.col("w")
    ssb = F.col("b") - F.col("s") * F.col("s") / F.col("w")
    f = (ssb / (F.col("cells") - 1)) / ((sst - ssb) / (F.col("n") - F.col("cells")))
    return total.select("cells", F.col("n").cast("long").alias("n"), F.when(sst > 0, ssb / sst).otherwise(0.0).alias("r2"), F.when(F.col("cells") > 1, f).otherwise(0.0).alias("f_statistic"))


def interaction_strengths(df: DataFrame, coded: dict[str, Column], value: Column, weight: Column | None = None, least: int = 30) -> DataFrame:
    """interaction_strength() of all pairs of discretised factors (a, b) in one explode and one aggregate."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(value.cast("double").alias("v"), w.alias("w"), *[c.cast("string").alias(f"c{k}") for k, c in enumerate(coded.values())])
    names = list(coded)
    pairs = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for i, j in combinations(range(len(names)), 2)]
    cells = rows.select("v", "w", F.explode(F.array(*pairs)).alias("p")).groupBy("p.a", "p.b", "p.x", "p.y")
    cells = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("q"))
    total = cells.filter(F.col("n") >= least).groupBy("a", "b").agg(
        F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), F.sum(F.col("s") * F.col("s") / F.col("w")).alias("between")
    )
    sst, ssb = F.expr("q - s * s / w"), F.expr("between - s * s / w")
    f = (ssb / (F.col("cells") - 1)) / ((sst - ssb) / (F.col("n") - F.col("cells")))
    return total.select("a", "b", "cells", F.col("n").cast("long").alias("n"), F.when(sst > 0, ssb / sst).otherwise(0.0).alias("r2"), F.when(F.col("cells") > 1, f).otherwise(0.0).alias("f_statistic"))


def top_factors(df: DataFrame, names: list[str], value: Column, most: int = 10, least: float = 0.0) -> DataFrame:
    """(factor, eta_squared) of the factors that explain most of a value's variance, most first; all in one explode."""
    each = df.select(value.cast("double").alias("r"), F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), level(F.col(n)).alias("v")) for n in names])).alias("k"))
    s = each.groupBy("k.factor", "k.v").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    between, square = F.sum(F.col("s") * F.col("s") / F.col("n")), F.sum("s") * F.sum("s") / F.sum("n")
    eta = s.groupBy("factor").agg(((between - square) / (F.sum("q") - square)).alias("eta_squared"))
    return eta.filter(F.col("eta_squared") >= least).orderBy(F.col("eta_squared").desc(), "factor").limit(most)


def level_union(train: DataFrame, test: DataFrame, factor: Column, y: Column, mu: Column) -> DataFrame:
    """A/E of each level in either frame, side by side; unstable if they differ by over 0.1."""
    table = lambda df, s: df.groupBy(level(factor).alias("level")).agg(F.count(F.lit(1)).alias(f"n_{s}"), (F.sum(y) / F.sum(mu)).alias(f"ae_{s}"))
    out = table(train, "train").join(table(test, "test"), "level", "full_outer")
    return out.withColumn("is_unstable", F.coalesce(F.abs(F.col("ae_train") - F.col("ae_test")) > 0.1, F.lit(False)))
