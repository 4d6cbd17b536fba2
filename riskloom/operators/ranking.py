"""Rank-based diagnostics: calibration bins, discrimination, Lorenz curve, lift and deciles."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.prefix import keep, ordered

#: Running sums that calibration collects, and the share of the whole that rounding may move one by.
GRID, SLACK = 100_000, 1e-9


def deciles(df: DataFrame, order: Column, key: Column, n: int = 10) -> DataFrame:
    """df with bin 0..n-1: count div n rows each by order, the rest in the last."""
    rows = df.count()
    size = max(1, rows // n)
    return ordered(df, [order.asc(), key.asc()]).withColumn("bin", F.least(F.floor((F.col("rn") - 1) / size), F.lit(n - 1)).cast("int")).drop("rn")


def decile_table(df: DataFrame, y: Column, mu: Column, exposure: Column, key: Column, n: int = 10) -> DataFrame:
    """Actual and expected rates per decile of mu."""
    d = deciles(df, mu, key, n).groupBy("bin")
    out = d.agg(F.count(F.lit(1)).alias("n"), F.sum(exposure).alias("exposure"), F.sum(y).alias("actual"), F.sum(mu).alias("expected"))
    return out.withColumns({
        "actual_rate": F.col("actual") / F.col("exposure"),
        "expected_rate": F.col("expected") / F.col("exposure"),
        "ae": F.col("actual") / F.col("expected"),
    })


def lift_chart(df: DataFrame, y: Column, mu: Column, exposure: Column, key: Column, n: int = 10) -> DataFrame:
    """decile_table() from the lowest decile, with lift on the whole's rate and cumulative shares."""
    table = decile_table(df, y, mu, exposure, key, n)  # n rows
    whole, run = Window.partitionBy(), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    base = F.sum("actual").over(whole) / F.sum("exposure").over(whole)
    return table.select(
        "bin", "n", "exposure", "actual", "expected", "actual_rate", "ae",
        (F.col("actual_rate") / base).alias("lift"),
        (100 * F.sum("actual").over(run) / F.sum("actual").over(whole)).alias("cumulative_actual_pct"),
        (100 * F.sum("expected").over(run) / F.sum("expected").over(whole)).alias("cumulative_expected_pct"),
        (100 * F.sum("exposure").over(run) / F.sum("exposure").over(whole)).alias("cumulative_exposure_pct"),
        (F.sum("actual").over(run) / F.sum("exposure").over(run) / base).alias("cumulative_lift"),
    )


def lift_summary(chart: DataFrame) -> dict:
    """Of a lift chart (a row per decile): the largest gap of the cumulative shares in percent, its decile, and the weak deciles.

    Deciles count from 1; a decile is weak if it is off by over a fifth, if one of the first three
    has a lift over 0.8, or one from the eighth on a lift below 1.2.
    """
    rows = sorted(chart.select("bin", "ae", "lift", "cumulative_actual_pct", "cumulative_expected_pct").collect(), key=lambda r: r["bin"])
    gaps = [abs((r["cumulative_actual_pct"] or 0.0) - (r["cumulative_expected_pct"] or 0.0)) for r in rows]
    most = max(gaps, default=0.0)
    off = lambda r: r["ae"] is not None and abs(r["ae"] - 1) > 0.2
    weak = [r["bin"] + 1 for r in rows if off(r) or r["bin"] < 3 and r["lift"] > 0.8 or r["bin"] > 6 and r["lift"] < 1.2]
    return {"ks": most, "ks_decile": gaps.index(most) + 1 if most > 0 else 1, "weak_deciles": weak}


def ratio_deciles(df: DataFrame, y: Column, model: Column, base: Column, exposure: Column, key: Column, n: int = 10) -> DataFrame:
    """Deciles of model over base, with the rates of all three: where a new model moves away from a base."""
    d = deciles(df.withColumn("_ratio", model / F.greatest(base, F.lit(1e-10))), F.col("_ratio"), key, n)
    rate = lambda c: F.sum(c) / F.sum(exposure)
    return d.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_ratio").alias("mean_ratio"), rate(y).alias("actual"), rate(model).alias("model"), rate(base).alias("base"),
        (F.sum(y) / F.sum(model)).alias("ae_model"), (F.sum(y) / F.sum(base)).alias("ae_base"),
    )


def calibration_bins(df: DataFrame, y: Column, mu: Column, exposure: Column, key: Column, n: int = 10) -> DataFrame:
    """Greedy bins by mu: one closes when it has 0.99 of an equal share of exposure, bins are left, and at least as many rows as bins are left.

    The ends of bins are found on running sums: one pass gives the sums at every so many rows, between
    which each end must lie, and a second one the few rows there, on which the bins are closed one by one.
    """
    rows = ordered(df.withColumn("_e", exposure.cast("double")), [mu.asc(), key.asc()], {"cum": F.col("_e")})
    rows = keep(rows)
    count, total = rows.agg(F.count(F.lit(1)), F.sum("_e")).first()
    share = 0.99 * (total or 0.0) / n
    step = max(1, (count or 0) // GRID)
    grid = rows.groupBy(F.floor((F.col("rn") - 1) / step).alias("k")).agg(F.max("rn").alias("rn"), F.max("cum").alias("cum")).orderBy("k").collect()
    room = lambda b: (count or 0) - (n - 1 - b)  # noqa: E731  rows that may be used so that each later bin has one
    reach = [g["cum"] for g in grid]
    low = high = 0.0
    places = F.lit(False)
    for _ in range(n - 1):  # the end of a bin is in one of these stretches, whichever rows ended those before
        first, last = bisect_left(reach, low + share - SLACK * (total or 0.0)), bisect_left(reach, high + share + SLACK * (total or 0.0))
        if first >= len(grid):
            break
        last = min(last, len(grid) - 1)
        places = places | F.col("rn").between(grid[first - 1]["rn"] if first else 0, grid[last]["rn"])
        low, high = reach[first - 1] if first else 0.0, reach[last]
    near = sorted((r["rn"], r["cum"]) for r in rows.filter(places).select("rn", "cum").collect())
    ends: list[int] = []
    done = 0.0
    for b in range(n - 1):
        hit = next(((rn, cum) for rn, cum in near if rn > (ends[-1] if ends else 0) and cum >= done + share and rn <= room(b)), None)
        if hit is None:
            break
        ends.append(hit[0])
        done = hit[1]
    bin_of = F.lit(0)
    for e in ends:
        bin_of = bin_of + F.when(F.col("rn") > e, 1).otherwise(0)
    out = rows.withColumn("bin", bin_of).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_e").alias("exposure"), F.sum(y).alias("actual"), F.sum(mu).alias("expected"), F.min(mu).alias("mu_min"), F.max(mu).alias("mu_max")
    )
    half = 1.96 * F.sqrt(F.greatest(F.col("actual"), F.lit(1.0))) / F.col("expected")
    return out.withColumn("ae", F.col("actual") / F.col("expected")).withColumns({
        "ae_low": F.greatest(F.col("ae") - half, F.lit(0.0)), "ae_high": F.col("ae") + half,
    })


def hosmer_lemeshow(bins: DataFrame) -> DataFrame:
    """Sum of (actual - expected)^2 / expected over calibration bins, and degrees of freedom."""
    return bins.agg(
        F.sum(F.when(F.col("expected") > 0, F.pow(F.col("actual") - F.col("expected"), F.lit(2.0)) / F.col("expected")).otherwise(0.0)).alias("chi2"),
        F.greatest(F.count(F.lit(1)) - 2, F.lit(1)).alias("df"),
    )


def discrimination(df: DataFrame, y: Column, mu: Column, exposure: Column, key: Column) -> DataFrame:
    """Gini (trapezoids over exposure, by mu per exposure from the highest), AUC = (Gini + 1)/2, KS, lift of the first 10 and 20 % of exposure."""
    rows = df.select((mu / exposure).alias("rate"), key.alias("_key"), y.cast("double").alias("_y"), exposure.cast("double").alias("_e"))
    run = ordered(rows, [F.col("rate").desc(), F.col("_key").asc()], {"cy": F.col("_y"), "ce": F.col("_e")})
    total_y, total_e = rows.agg(F.sum("_y"), F.sum("_e")).first()
    if not total_y or not total_e:
        return df.sparkSession.createDataFrame([(0.0, 0.5, 0.0, 1.0, 1.0)], "gini double, auc double, ks double, lift_10 double, lift_20 double")
    fy, fe = F.col("cy") / total_y, F.col("ce") / total_e
    step = F.col("_e") / total_e * (fy + fy - F.col("_y") / total_y) / 2
    top = lambda p: F.max(F.when(fe <= p, fy)) / p
    return run.agg((2 * F.sum(step) - 1).alias("gini"), F.sum(step).alias("auc"), F.max(F.abs(fy - fe)).alias("ks"), F.coalesce(top(0.1), F.lit(0.0)).alias("lift_10"), F.coalesce(top(0.2), F.lit(0.0)).alias("lift_20"))


def lorenz(df: DataFrame, y: Column, mu: Column, exposure: Column, key: Column, steps: int = 20) -> DataFrame:
    """Shares of actual and expected up to each step of exposure, by mu from the lowest: the first row at or past it."""
    rows = df.select(mu.cast("double").alias("_m"), key.alias("_key"), y.cast("double").alias("_y"), exposure.cast("double").alias("_e"))
    run = ordered(rows, [F.col("_m").asc(), F.col("_key").asc()], {"cy": F.col("_y"), "cm": F.col("_m"), "ce": F.col("_e")})
    total_y, total_m, total_e = rows.agg(F.sum("_y"), F.sum("_m"), F.sum("_e")).first()
    share = F.col("ce") / total_e
    step = F.least(F.floor(share * steps + 1e-9), F.lit(steps)).cast("int")
    first = run.withColumn("reached", step).withColumn("own", F.explode(F.sequence(F.greatest(F.ceil((share - F.col("_e") / total_e) * steps + 1e-9).cast("int"), F.lit(1)), F.greatest(F.col("reached"), F.lit(1)))))
    first = first.filter(F.col("own") <= F.col("reached"))
    return first.groupBy("own").agg(F.min(F.struct("rn", "cy", "cm", "ce")).alias("f")).select(
        F.col("own").alias("step"),
        (F.col("f.ce") / total_e).alias("exposure_share"),
        (F.col("f.cy") / total_y).alias("actual_share"),
        (F.col("f.cm") / total_m).alias("expected_share"),
    )

