"""Ordered prefix sums and ranks without sending all rows to one task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_scopes: list[list[DataFrame]] = []


@contextmanager
def released() -> Iterator[None]:
    """Frames that operators keep while this is open are given up when it closes; collect their results within it."""
    own: list[DataFrame] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for df in own:
            df.unpersist()


def keep(df: DataFrame) -> DataFrame:
    """df in memory or on disk, until the released() around it closes."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _scopes:
        _scopes[-1].append(df)
    return df


def ordered(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """df with rn (1, 2, ... in order) and running sums, named by the keys of sums.

    Rows are range-partitioned by the order; what comes before each partition is a few numbers per
    partition, summed on the driver, and within partitions a window does the rest. The order must
    end with a unique key. df is kept, so that both steps see one partitioning; see released().
    """
    sums = sums or {}
    ranged = df.withColumns({f"_v_{k}": c.cast("double") for k, c in sums.items()})
    ranged = keep(ranged.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_v_{k}").alias(k) for k in sums]).orderBy("_part").collect()
    before, n, run = [], 0, dict.fromkeys(sums, 0.0)
    for t in totals:
        before.append((t["_part"], n, *run.values()))
        n += t["n"]
        run = {k: v + (t[k] or 0.0) for k, v in run.items()}
    names = ["_part", "_b_rn", *[f"_b_{k}" for k in sums]]
    schema = ", ".join([f"{names[0]} int", f"{names[1]} long", *[f"{x} double" for x in names[2:]]])
    offsets = df.sparkSession.createDataFrame(before or [(-1, 0, *run.values())], schema)  # one row per partition
    w = Window.partitionBy("_part").orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_part")
    out = out.withColumn("rn", F.row_number().over(w) + F.col("_b_rn"))
    for k in sums:
        out = out.withColumn(k, F.sum(f"_v_{k}").over(running) + F.col(f"_b_{k}"))
    return out.drop("_part", *[f"_v_{k}" for k in sums], *names[1:])


def within(df: DataFrame, key: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sums over the rows of the same key (not null) that come before each row, 0 for the first.

    Rows are range-partitioned by key and order, so that a key with very many rows lies in several
    partitions; what a partition's first key has before it is carried over, a few numbers per partition.
    """
    ranged = df.withColumns({"_k": key, **{f"_v_{k}": F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in sums.items()}})
    ranged = keep(ranged.repartitionByRange(F.col("_k"), *order).withColumn("_part", F.spark_partition_id()))
    each = ranged.groupBy("_part", "_k").agg(*[F.sum(f"_v_{k}").alias(k) for k in sums])
    ends = each.groupBy("_part").agg(F.min("_k").alias("first"), F.max(F.struct("_k", *sums)).alias("last")).orderBy("_part").collect()
    carried, held, run = [], None, [0.0] * len(sums)
    for t in ends:
        own = [t["last"][k] for k in sums]
        if held == t["first"]:
            carried.append((t["_part"], t["first"], *run))
        run = [a + b for a, b in zip(run, own, strict=True)] if held == t["first"] == t["last"]["_k"] else own
        held = t["last"]["_k"]
    schema = ", ".join(["_part int", f"_k {ranged.schema['_k'].dataType.simpleString()}", *[f"_b_{k} double" for k in sums]])
    offsets = df.sparkSession.createDataFrame(carried, schema)  # one row per partition at most
    before = Window.partitionBy("_part", "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), ["_part", "_k"], "left")
    for k in sums:
        out = out.withColumn(k, F.coalesce(F.sum(f"_v_{k}").over(before), F.lit(0.0)) + F.coalesce(f"_b_{k}", F.lit(0.0)))
    return out.drop("_part", "_k", *[f"_v_{k}" for k in sums], *[f"_b_{k}" for k in sums])


def value_at_ranks(df: DataFrame, value: Column, ranks: list[int]) -> list[float]:
    """The values at the given ranks (from 1) of the sorted finite values; equal values share one row of counts."""
    counts = df.select(value.cast("double").alias("v")).filter(finite(F.col("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    wanted = sorted(set(ranks))
    hit = [F.min(F.when(F.col("upto") >= r, F.col("v"))).alias(f"r{k}") for k, r in enumerate(wanted)]
    with released():
        row = ordered(counts, [F.col("v")], {"upto": F.col("n")}).agg(*hit).first()
    found = dict(zip(wanted, row, strict=True))
    return [found[r] for r in ranks]


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
