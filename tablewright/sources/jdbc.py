"""Database reads: the query is pushed down, the read is range partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def query_table(query: str) -> str:
    return f"({query.strip().rstrip(';')}) pushed"


def read_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Push a query to the database and read its result."""
    return spark.read.format("jdbc").options(url=url, dbtable=query_table(query), **options).load()


def folded_type(data_type: T.DataType) -> T.DataType:
    """Column types a database read is folded to: decimals to double, small
    integers to int, dates and times and anything unusual to string."""
    if isinstance(data_type, T.DecimalType):
        return T.DoubleType()
    if isinstance(data_type, (T.ByteType, T.ShortType)):
        return T.IntegerType()
    kept = (
        T.BooleanType,
        T.FloatType,
        T.DoubleType,
        T.IntegerType,
        T.LongType,
        T.BinaryType,
    )
    return data_type if isinstance(data_type, kept) else T.StringType()


def folded_columns(schema: T.StructType) -> list[Column]:
    return [
        F.col(f"`{f.name}`").cast(folded_type(f.dataType)).alias(f.name.lower())
        for f in schema.fields
    ]


def fold_types(df: DataFrame) -> DataFrame:
    """Lower-case the names and fold the types of a table."""
    return df.select(*folded_columns(df.schema))


def read_partitioned(
    spark: SparkSession,
    url: str,
    query: str,
    column: str,
    lower: int = 0,
    upper: int = 2**31 - 1,
    partitions: int = 1,
    **properties: str,
) -> DataFrame:
    """Read a query in `partitions` ranges of `column`, names and types folded.

    The bounds only place the range borders; rows outside them are still read.
    """
    df = spark.read.jdbc(
        url,
        query_table(query),
        column=column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties,
    )
    return fold_types(df)
