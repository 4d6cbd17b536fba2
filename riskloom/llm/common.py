"""What the operators share: session settings, staged tables, arrays of strings, digests."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.workers import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows and bytes per Arrow batch: keep a batch of long texts far below a worker's memory.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20
#: A key is hot if it has more than one in so many of all rows, so that there are fewer hot keys than that.
HOT_SHARE = 1000
#: Places that the rows of a hot key are dealt out to.
SALTS = 64


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches (a smaller setting of the session stays) and ship this package to the workers."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        held = re.match(r"-?\d+", spark.conf.get(name))
        if not held or not 0 < int(held[0]) <= most:
            spark.conf.set(name, str(most))
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset on a single machine (a local master, as in tests) a temporary folder is
    set instead; on a cluster each executor would write to a disk of its own, so there it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        top = getattr(spark, "_riskloom_dir", None)
        if top is None:
            made = tempfile.mkdtemp(prefix="riskloom-")
            atexit.register(shutil.rmtree, made, True)
            top = spark._riskloom_dir = Path(made).as_uri()
    return f"{top.rstrip('/')}/riskloom-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The folder of the application is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    top = shared_dir(spark)
    path = f"{top}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _remove_at_exit(spark, top)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to differ from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined (left outer) with right, in which a key stands once at most.

    Rows of left under a null key, or under a hot one (there are fewer than HOT_SHARE of these, which
    bounds what is broadcast), are dealt out by their other columns, and right's rows of hot keys are
    repeated for each place.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col(key).isNotNull())
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    salt, place = free(left, "_salt"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    if not total or most * HOT_SHARE <= total:
        left = left.withColumn(salt, F.when(F.col(key).isNull(), place).otherwise(0))
        return left.join(right.withColumn(salt, F.lit(0)), [key, salt], "left").drop(salt)
    hot = F.broadcast(counts.filter(F.col("n") * HOT_SHARE > total).select(F.col(key), F.lit(True).alias("_hot")))
    left = left.join(hot, key, "left").withColumn(salt, F.when(F.col("_hot") | F.col(key).isNull(), place).otherwise(0)).drop("_hot")
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(hot, key, "left").withColumn(salt, F.explode(places)).drop("_hot")
    return left.join(right, [key, salt], "left").drop(salt)


def dropped(df: DataFrame) -> None:
    """Delete what staged() wrote for df, once nothing reads it any more."""
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_registered: set[str] = set()


def _remove_at_exit(spark: SparkSession, top: str) -> None:
    if top in _registered:
        return
    _registered.add(top)

    def remove() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has gone; the cluster's own cleaning remains
            pass

    atexit.register(remove)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only, other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def remainder(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, mod modulus; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def remainder_col(doc_id: Column, modulus: int) -> Column:
    """remainder() as a Column."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null gives the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def ragged(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Lists of numbers from arrays."""
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))
