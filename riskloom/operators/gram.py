"""Sums over rows that fits need, as one distributed pass: X'WX, X'Wz and scalars."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.workers import ship

#: Partials that go straight to the driver; more are first summed in groups on the executors.
DIRECT_PARTIALS = 64


def row_sums(design: DataFrame, f: Callable[..., np.ndarray], size: int, partitions: int = 1, more: tuple[str, ...] = ()) -> np.ndarray:
    """Sum over batches of f(x, y, w, o, *more), a vector of `size`; design has x (array), y, w, o and what more names.

    Each task adds up its batches in numpy and hands on one vector. Vectors of many tasks are summed
    in groups of about their square root before the driver adds the rest, in order of partition.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                rest = [b.column(k).to_numpy(zero_copy_only=False) for k in range(1, b.num_columns)]
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                total += f(x, *rest)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def grouped(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in sorted(table.column("v").to_pylist()))
        return pa.table({"v": pa.array([total.tobytes()], pa.binary())})

    ship(design.sparkSession)
    parts = design.select("x", "y", "w", "o", *more).mapInArrow(partial, "v binary")
    if partitions > DIRECT_PARTIALS:
        groups = math.ceil(math.sqrt(partitions))
        parts = parts.groupBy((F.spark_partition_id() % groups).alias("g")).applyInArrow(grouped, "v binary")
    vectors = [np.frombuffer(bytes(r["v"]), np.float64) for r in parts.collect()]  # a vector per task or group
    return np.sum(vectors, axis=0) if vectors else np.zeros(size)


def packed(gram: np.ndarray, *vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([gram.ravel(), *[np.atleast_1d(v) for v in vectors]])
