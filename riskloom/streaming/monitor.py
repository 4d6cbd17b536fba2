"""Scoring and actual-versus-expected monitoring of streams; an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.factors import level


def score_stream(model, stream: DataFrame, name: str = "prediction") -> DataFrame:
    """Predictions on a streaming frame: a projection, with lookups of encodings against static tables."""
    return model.predict(stream, name)


def monitor(stream: DataFrame, time: str, factor: Column, y: Column, mu: Column, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A/E by event-time window and level; rows later than `late` are dropped by the watermark."""
    stamped = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = stamped.withWatermark(time, late).groupBy(F.window(time, window), level(factor).alias("level"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("actual"), F.sum(mu).alias("expected"))
    return out.select(F.col("window.start").alias("start"), "level", "n", "actual", "expected", (F.col("actual") / F.col("expected")).alias("ae"))
