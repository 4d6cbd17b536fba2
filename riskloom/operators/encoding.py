"""Target and frequency encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.factors import level
from riskloom.operators.prefix import within


def interaction_key(*factors: Column) -> Column:
    """Levels of several factors as one: a:b:..."""
    return F.concat_ws(":", *[level(f) for f in factors])


def target_stats(df: DataFrame, key: Column, y: Column, exposure: Column | None = None) -> tuple[DataFrame, float]:
    """(level, total, size; the prior). Sizes are rows, or exposure, and the prior the whole's rate."""
    e = F.lit(1.0) if exposure is None else exposure.cast("double")
    stats = df.groupBy(key.alias("level")).agg(F.sum(y.cast("double")).alias("total"), F.sum(e).alias("size"))
    row = stats.agg(F.sum("total"), F.sum("size")).first()
    return stats, (row[0] or 0.0) / max(row[1] or 0.0, 1e-10)


def target_apply(df: DataFrame, key: Column, stats: DataFrame, prior: float, weight: float = 1.0, name: str = "encoded") -> DataFrame:
    """(total + prior * weight) / (size + weight) of each row's level; unknown levels have the prior."""
    value = (F.col("total") + F.lit(prior * weight)) / (F.col("size") + F.lit(weight))
    lookup = stats.select(F.col("level").alias("_level"), value.alias(name))
    out = df.withColumn("_key", key).join(lookup, F.col("_key") == F.col("_level"), "left")
    return out.withColumn(name, F.coalesce(name, F.lit(prior))).drop("_key", "_level")


def target_ordered(
    df: DataFrame, key: Column, y: Column, orders: list[list[Column]], prior: float, weight: float = 1.0, exposure: Column | None = None, name: str = "encoded"
) -> DataFrame:
    """Ordered target statistics: each row sees only rows of its level that come before it, averaged over orders.

    A level with very many rows is spread over several partitions.
    """
    e = F.lit(1.0) if exposure is None else exposure.cast("double")
    total = F.lit(0.0)
    out = df
    for k, order in enumerate(orders):
        out = within(out, key, order, {f"_s{k}": y, f"_n{k}": e})
        total = total + (F.col(f"_s{k}") + F.lit(prior * weight)) / (F.col(f"_n{k}") + F.lit(weight))
    return out.withColumn(name, total / len(orders)).select(*df.columns, name)


def permutations(row_id: Column, n: int = 4, seed: int = 42) -> list[list[Column]]:
    """n orders of the rows by hashes of a unique key."""
    return [[F.xxhash64(F.lit(seed + k), row_id), row_id] for k in range(n)]


def frequency_stats(df: DataFrame, key: Column) -> tuple[DataFrame, int]:
    """(level, n; the largest n)."""
    stats = df.groupBy(key.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return stats, stats.agg(F.max("n")).first()[0] or 1


def frequency_apply(df: DataFrame, key: Column, stats: DataFrame, largest: int, name: str = "encoded") -> DataFrame:
    """Count of each row's level over the largest count; 0 for unknown levels."""
    lookup = stats.select(F.col("level").alias("_level"), (F.col("n") / F.lit(float(largest))).alias(name))
    out = df.withColumn("_key", key).join(lookup, F.col("_key") == F.col("_level"), "left")
    return out.withColumn(name, F.coalesce(name, F.lit(0.0))).drop("_key", "_level")


class TargetEncoder:
    """fit() learns levels of one column; transform() encodes any frame with them."""

    def __init__(self, column: str, target: str, weight: float = 1.0, exposure: str | None = None, row_id: str | None = None, n_permutations: int = 4, seed: int = 42):
        self.column, self.target, self.weight, self.exposure = column, target, weight, exposure
        self.row_id, self.n_permutations, self.seed = row_id, n_permutations, seed
        self.stats: DataFrame | None = None
        self.prior = 0.0

    def fit(self, df: DataFrame) -> TargetEncoder:
        self.stats, self.prior = target_stats(df, level(F.col(self.column)), F.col(self.target), F.col(self.exposure) if self.exposure else None)
        return self

    def transform(self, df: DataFrame, name: str = "encoded") -> DataFrame:
        return target_apply(df, level(F.col(self.column)), self.stats, self.prior, self.weight, name)

    def fit_transform(self, df: DataFrame, name: str = "encoded") -> DataFrame:
        """Ordered statistics on the frame that is learnt from, so that no row sees its own target."""
        self.fit(df)
        rid = F.col(self.row_id) if self.row_id else F.xxhash64(*[F.col(c) for c in df.columns])
        return target_ordered(df, level(F.col(self.column)), F.col(self.target), permutations(rid, self.n_permutations, self.seed), self.prior, self.weight, F.col(self.exposure) if self.exposure else None, name)


class FrequencyEncoder:
    """fit() counts the levels of one column; transform() gives count over largest count."""

    def __init__(self, column: str):
        self.column = column
        self.stats: DataFrame | None = None
        self.largest = 1

    def fit(self, df: DataFrame) -> FrequencyEncoder:
        self.stats, self.largest = frequency_stats(df, level(F.col(self.column)))
        return self

    def transform(self, df: DataFrame, name: str = "encoded") -> DataFrame:
        return frequency_apply(df, level(F.col(self.column)), self.stats, self.largest, name)

    def fit_transform(self, df: DataFrame, name: str = "encoded") -> DataFrame:
        return self.fit(df).transform(df, name)
