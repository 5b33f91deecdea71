"""Post-processing of a table as a query request asks for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def order_columns(spec: str) -> list[Column]:
    """Columns of an order list such as ``"a, b desc"``."""
    columns = []
    for item in spec.split(","):
        words = item.split()
        if len(words) == 1 or (len(words) == 2 and words[1] == "asc"):
            columns.append(F.col(words[0]).asc())
        elif len(words) == 2 and words[1] == "desc":
            columns.append(F.col(words[0]).desc())
        else:
            raise ValueError(f"cannot read order item {item!r}")
    return columns


def order_by_spec(df: DataFrame, spec: str) -> DataFrame:
    return df.orderBy(*order_columns(spec))


def select_columns(df: DataFrame, names: str) -> DataFrame:
    """Keep a comma-separated list of columns."""
    return df.select(*[F.col(name.strip()) for name in names.split(",")])


def filter_expr(df: DataFrame, predicate: str) -> DataFrame:
    return df.filter(F.expr(predicate))


def count_rows(df: DataFrame, name: str = "count") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def run_sql(spark: SparkSession, statement: str) -> DataFrame:
    """Run SQL text over the registered views."""
    return spark.sql(statement)


def temp_view(df: DataFrame, name: str, cache: bool = False) -> DataFrame:
    """Register `df` for SQL; `cache` keeps it in executor memory."""
    df.createOrReplaceTempView(name)
    if cache:
        df.sparkSession.catalog.cacheTable(name)
    return df.sparkSession.table(name)


def apply_request(
    df: DataFrame,
    filter: str | None = None,
    select: str | None = None,
    distinct: bool = False,
    order_by: str | None = None,
    limit: int | None = None,
    count: bool = False,
) -> DataFrame:
    """Filter, select, distinct, order, limit, count: always in that order."""
    if filter is not None:
        df = filter_expr(df, filter)
    if select is not None:
        df = select_columns(df, select)
    if distinct:
        df = df.distinct()
    if order_by is not None:
        df = order_by_spec(df, order_by)
    if limit is not None:
        df = df.limit(limit)
    return count_rows(df) if count else df
