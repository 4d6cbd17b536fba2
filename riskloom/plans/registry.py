"""Registration of queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Views that queries of both sides start from: y, mu, exposure e, factors f and g, x, a base's means, a unique id.
ORDERS = """o AS (
  SELECT o_orderkey AS id, o_totalprice / 1e3 AS y, 1e2 + 3e1 * (o_custkey % 7) AS mu, 1e0 + (o_orderkey % 4) AS e,
    o_orderpriority AS f, o_orderstatus AS g, 1e0 * (o_custkey % 97) AS x, 9e1 + 5e1 * (o_custkey % 5) AS base, 1e0 AS one
  FROM orders)"""
LINES = """l AS (
  SELECT l_quantity AS y, l_extendedprice / 1e3 AS p, l_discount AS x, l_tax AS t, l_returnflag AS f, l_linestatus AS g,
    2e1 + 1e2 * l_discount AS mu, 1e0 + l_linenumber AS e, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS b,
    CAST(l_linenumber AS VARCHAR) AS line
  FROM lineitem)"""


class _Columns:
    """c.name is the column of that name; made when used, as that needs a session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


c = _Columns()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view o."""
    t = table(spark, sf_dir, "orders")
    cust, k = F.col("o_custkey"), F.col("o_orderkey")
    return t.select(
        k.alias("id"), (F.col("o_totalprice") / 1e3).alias("y"), (1e2 + 3e1 * (cust % 7)).alias("mu"), (1e0 + (k % 4)).alias("e"), F.col("o_orderpriority").alias("f"),
        F.col("o_orderstatus").alias("g"), (1e0 * (cust % 97)).alias("x"), (9e1 + 5e1 * (cust % 5)).alias("base"), F.lit(1.0).alias("one"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view l."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1e3).alias("p"), F.col("l_discount").alias("x"), F.col("l_tax").alias("t"),
        F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("g"), (2e1 + 1e2 * F.col("l_discount")).alias("mu"), (1e0 + F.col("l_linenumber")).alias("e"),
        F.when(F.col("l_returnflag") == "R", 1e0).otherwise(0e0).alias("b"), F.col("l_linenumber").cast("string").alias("line"),
    )


def _kinds(columns: str) -> list[tuple[str, str, int]]:
    """Names with their kind: name* a long, name.3 a double with so many digits, name as it is."""
    out = []
    for word in columns.split():
        if word.endswith("*"):
            out.append((word[:-1], "long", 0))
        elif "." in word:
            name, digits = word.split(".")
            out.append((name, "double", int(digits or 3)))
        else:
            out.append((word, "", 0))
    return out


def query(columns: str, sql: str | None = None) -> Callable:
    """Register f(spark, sf_dir) under its name; both sides give the listed columns, doubles rounded."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        kinds = _kinds(columns)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[
                (F.round(F.col(n).cast("double"), d) + 0.0).alias(n) if k == "double" else F.col(n).cast("long").alias(n) if k == "long" else F.col(n)
                for n, k, d in kinds
            ])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            outer = ", ".join(
                f"round(CAST({n} AS DOUBLE), {d}) + 0e0 AS {n}" if k == "double" else f"CAST({n} AS BIGINT) AS {n}" if k == "long" else n for n, k, d in kinds
            )
            text = sql.replace("{orders}", ORDERS).replace("{lines}", LINES)
            ORACLE_SQL[f.__name__] = f"SELECT {outer} FROM ({text})"
        return f

    return add
