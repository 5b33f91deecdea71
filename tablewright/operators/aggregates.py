"""Grouped aggregates; all combine on the map side before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.operators.ordering import numbered
from tablewright.storage import cut_lineage


def sums_sorted(
    df: DataFrame, group: str, columns: Sequence[str], descending: bool = True
) -> DataFrame:
    """Sum of each column per group, sorted by the group."""
    order = F.col(group).desc() if descending else F.col(group).asc()
    return df.groupBy(group).agg(*[F.sum(c).alias(c) for c in columns]).orderBy(order)


def typed_aggregate(field: T.StructField) -> Column:
    """Aggregate chosen by type: int takes the minimum, long the maximum,
    everything else counts."""
    if isinstance(field.dataType, T.IntegerType):
        return F.min(field.name).alias(field.name)
    if isinstance(field.dataType, T.LongType):
        return F.max(field.name).alias(field.name)
    return F.count(field.name).alias(field.name)


def aggregate_by_type(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Group by `groups`; every other column gets the aggregate of its type."""
    others = [f for f in df.schema.fields if f.name not in groups]
    return df.groupBy(*groups).agg(*[typed_aggregate(f) for f in others])


def count_by(df: DataFrame, category: str, where: str | None = None) -> DataFrame:
    rows = df if where is None else df.filter(F.expr(where))
    return rows.groupBy(category).agg(F.count("*").alias("n"))


def rate_table(df: DataFrame, category: str, hit: str) -> DataFrame:
    """Hit rates per category that has a hit, best rate first.

    Overall totals include rows without a category.  The category counts are
    written once; totals are summed from them as scalar subqueries, so the
    rows are read once and nothing is joined.
    """
    flag = F.coalesce(F.expr(hit), F.lit(False))
    counts = cut_lineage(
        df.select(F.col(category), flag.alias("_hit"))
        .groupBy(category)
        .agg(F.count_if("_hit").alias("hits"), F.count("*").alias("total")),
        "counts",
    )
    all_rows = counts.agg(F.sum("total")).scalar()
    all_hits = counts.agg(F.sum("hits")).scalar()
    per_category = counts.filter(F.col(category).isNotNull() & (F.col("hits") > 0))
    share = F.col("hits") / F.col("total")
    return per_category.select(
        F.col(category),
        share.alias("rate"),
        "hits",
        "total",
        F.try_divide(F.col("hits").cast("double"), all_hits).alias("hits_to_all_hits"),
        share.alias("hits_to_total"),
        F.try_divide(F.col("total").cast("double"), all_rows).alias("total_to_all"),
    ).orderBy(F.col("rate").desc(), F.col(category))


def collect_group(
    df: DataFrame, key: str, value: str, chunk_size: int = 100_000
) -> DataFrame:
    """All values of each key, sorted, in arrays of at most `chunk_size`.

    Rows are numbered in (key, value) order by a distributed sort and every
    `chunk_size` numbers form a chunk, so a key with billions of values
    becomes many bounded arrays on many tasks.  The sort's last column is
    random, so that equal rows can be split as well.  A key's chunks are
    consecutive, and count from 0 after its first one is subtracted.
    """
    rows = df.select(key, value, F.rand(0).alias("_tie"))
    positions = numbered(rows, [key, value, "_tie"], name="_pos", start=0)
    place = F.floor(F.col("_pos") / F.lit(chunk_size)).alias("_place")
    arrays = positions.groupBy(key, place).agg(
        # In a struct, as collecting bare values would leave nulls out; they come first.
        F.transform(F.sort_array(F.collect_list(F.struct(value))), lambda s: s[value]).alias("values")
    )
    firsts = positions.groupBy(F.col(key).alias("_key")).agg(F.min(place).alias("_first"))
    return arrays.join(firsts, F.col(key).eqNullSafe(F.col("_key"))).select(
        key, (F.col("_place") - F.col("_first")).alias("chunk"), "values"
    )


def plan_score(df: DataFrame, group: str, error: str, weight: str) -> DataFrame:
    """Sum of valid errors over (sum of their weights) ** 1.5; null if none is valid."""
    valid = df.filter(F.col(error) > 0)
    total = F.pow(F.sum(weight).cast("double"), F.lit(1.5))
    return valid.groupBy(group).agg((F.sum(error) / F.nullif(total, F.lit(0.0))).alias("score"))


def union_header_rows(header: DataFrame, rows: DataFrame) -> DataFrame:
    """A header line before row lines; `line_no` keeps the order explicit."""
    return header.unionByName(rows)
