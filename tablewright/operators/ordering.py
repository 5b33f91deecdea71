"""Global positions and running totals computed partition by partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.storage import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row offset in the low 33 bits


def _sorted_slots(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partitioned sort, written once, with partition and offset columns."""
    slotted = df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    return (
        cut_lineage(slotted, "sorted")
        .withColumn("_part", F.shiftright("_slot", _ROW_BITS))
        .withColumn("_offset", F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )


def _before_each_part(totals: DataFrame) -> DataFrame:
    """Sum of all earlier parts; one row per sort partition, so a small window."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )


def numbered(
    df: DataFrame, order: Sequence[Column | str], name: str = "row_number", start: int = 1
) -> DataFrame:
    """Number all rows in `order`.

    The sort is range partitioned; only one count per sort partition is
    combined centrally, so no task ever sees the whole table.
    """
    slots = _sorted_slots(df, order)
    before = _before_each_part(slots.groupBy("_part").agg(F.count("*").alias("_total")))
    position = F.col("_before") + F.col("_offset") + F.lit(start)
    return (
        slots.join(before, "_part")
        .withColumn(name, position.cast("long"))
        .drop("_slot", "_part", "_offset", "_before")
    )


def running_total(
    df: DataFrame, order: Sequence[Column | str], weight: str, name: str = "running"
) -> DataFrame:
    """Inclusive running sum of `weight` over all rows in `order`."""
    slots = _sorted_slots(df, order)
    before = _before_each_part(slots.groupBy("_part").agg(F.sum(weight).alias("_total")))
    inside = (
        Window.partitionBy("_part")
        .orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        slots.withColumn("_inside", F.sum(weight).over(inside))
        .join(before, "_part")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_slot", "_part", "_offset", "_before", "_inside")
    )


def sort_all_columns(df: DataFrame) -> DataFrame:
    """Sort by every column, left to right."""
    return df.orderBy(*df.columns)


def top_by_weight(
    df: DataFrame, weight: str, k: int, ties: Sequence[str] = ()
) -> DataFrame:
    """The k rows of largest weight; `ties` makes the choice repeatable."""
    return df.orderBy(F.col(weight).desc(), *[F.col(t).asc() for t in ties]).limit(k)
