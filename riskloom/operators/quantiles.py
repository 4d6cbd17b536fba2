"""The three quantile conventions; they differ and are kept apart."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.operators.prefix import finite, ordered, value_at_ranks


def _count(df: DataFrame, value: Column) -> int:
    return df.filter(finite(value.cast("double"))).count()


def floor_rank(df: DataFrame, value: Column, probabilities: list[float]) -> list[float]:
    """sorted[int(p(n-1))]: spline knots."""
    n = _count(df, value)
    return value_at_ranks(df, value, [int(p * (n - 1)) + 1 for p in probabilities]) if n else []


def round_rank(df: DataFrame, value: Column, probabilities: list[float]) -> list[float]:
    """sorted[round(p(n-1))], halves up: edges of actual-versus-expected bins, percentiles of residuals."""
    n = _count(df, value)
    return value_at_ranks(df, value, [math.floor(p * (n - 1) + 0.5) + 1 for p in probabilities]) if n else []


def linear(df: DataFrame, value: Column, probabilities: list[float]) -> list[float]:
    """Interpolated between the two ranks around p(n-1): percentile bands of the exploration."""
    n = _count(df, value)
    if not n:
        return []
    at = [p * (n - 1) for p in probabilities]
    below, above = [math.floor(a) for a in at], [math.ceil(a) for a in at]
    found = value_at_ranks(df, value, [k + 1 for k in below + above])
    low, high = found[: len(at)], found[len(at) :]
    return [x + (a - k) * (y - x) for x, y, a, k in zip(low, high, at, below, strict=True)]


#: Distinct values of a factor that are listed on the driver at most.
MOST_LEVELS = 100_000


def fixed_levels(df: DataFrame, value: Column) -> list[str]:
    """The sorted distinct values that aren't null; raises if there are too many to list."""
    rows = df.select(value.cast("string").alias("v")).filter("v is not null").distinct().limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValidationError(f"over {MOST_LEVELS} different values: not a factor")
    return sorted(r[0] for r in rows)


def ranked(df: DataFrame, value: Column) -> Column:
    """The rank (from 0) of a value among the sorted distinct ones; null has the one after the last."""
    levels = fixed_levels(df, value)
    if not levels:
        return F.lit(0)
    places = F.create_map(*[x for k, v in enumerate(levels) for x in (F.lit(v), F.lit(k))])
    return F.coalesce(F.get(F.array(places), F.lit(0))[value.cast("string")], F.lit(len(levels)))


def factorized(df: DataFrame, value: Column, name: str = "code") -> DataFrame:
    """df with the rank (from 0) of each row's level among the sorted levels, null as the level None; any number of levels."""
    own = F.coalesce(value.cast("string"), F.lit("None"))
    levels = df.select(own.alias("_level")).distinct()
    codes = ordered(levels, [F.col("_level")]).select("_level", (F.col("rn") - 1).cast("int").alias(name))
    return df.withColumn("_own", own).join(codes, F.col("_own") == F.col("_level")).drop("_own", "_level")


def indicators(code: Column, n: int) -> Column:
    """The design of a factor from its codes, as an array: n - 1 columns, code 0 is the reference."""
    return F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.when(k == code, 1.0).otherwise(0.0)) if n > 1 else F.array().cast("array<double>")


def band(value: Column, edges: list[float]) -> Column:
    """The number of inner edges that are not above value: 0 for the first band."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(value >= F.lit(e), 1).otherwise(0)
    return out


def unique_edges(edges: list[float]) -> list[float]:
    return sorted(set(edges))


def discretized(df: DataFrame, value: Column, n_bins: int = 5) -> Column:
    """Number of the quantile bin; values that aren't finite have the bin n_bins. Edges are linear quantiles.

    Strings that all are numbers are taken as such; others have the rank of their value among the
    sorted distinct ones (fixed_levels() bounds these), null the one after.
    """
    v = value.cast("double")
    if df.select(value.alias("v")).schema["v"].dataType.typeName() == "string":
        number = F.expr("try_cast(v AS double)")
        texts = df.select(value.alias("v")).filter("v is not null").agg(F.count(F.lit(1)), F.count(number)).first()
        if texts[0] and texts[0] != texts[1]:
            return ranked(df, value)
        v = value.try_cast("double")
    inner = linear(df, v, [k / n_bins for k in range(1, n_bins)])
    return F.when(finite(v), band(v, inner)).otherwise(n_bins)
