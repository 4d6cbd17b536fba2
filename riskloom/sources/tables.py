"""Tables and stored models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.errors import SerializationError, ValidationError


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, file_format: str = "parquet") -> DataFrame:
    """A table by any of Spark's readers; only the given columns are read."""
    df = spark.read.format(file_format).load(path)
    if columns:
        lost = [c for c in columns if c not in df.columns]
        if lost:
            raise ValidationError(f"no column {', '.join(lost)} in {path}")
        df = df.select(*columns)
    return df


def save_model(spark: SparkSession, model, path: str) -> None:
    """Write a model's JSON to a folder that Spark can write."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str):
    """Read a model that save_model() wrote."""
    from riskloom.operators.model import Model

    rows = spark.read.text(path).take(2)
    if len(rows) != 1:
        raise SerializationError(f"{path} does not hold one model")
    return Model.from_json(spark, rows[0]["value"])


def write_json(report: dict, path: str) -> None:
    """A report as JSON in a local file; reports never write by themselves."""
    import json

    with open(path, "w") as f:
        json.dump(report, f, indent=2, default=str)
