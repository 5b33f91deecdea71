"""Tables made from literals, ranges and random numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def rows_to_table(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(list(rows), schema)


def number_range(spark: SparkSession, start: int, end: int, name: str = "id") -> DataFrame:
    """The integers from `start` to `end`, both included."""
    return spark.range(start, end + 1).withColumnRenamed("id", name)


def random_normals(
    spark: SparkSession,
    n: int,
    partitions: int,
    mean: float = 1.0,
    deviation: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """`n` independent normal numbers, drawn where they are stored."""
    draws = spark.range(0, n, 1, partitions)
    return draws.select("id", (F.lit(mean) + F.lit(deviation) * F.randn(seed)).alias("value"))
