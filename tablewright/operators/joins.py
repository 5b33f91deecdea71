"""Joins.  No side is broadcast by hand: Spark compares sizes, and its
adaptive skew handling splits a hot key across tasks (see session.py)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def join_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two key-value tables."""
    return left.join(right, key)


def join_null_safe(
    left: DataFrame,
    right: DataFrame,
    pairs: Sequence[tuple[str, str]],
    residual: Column | None = None,
) -> DataFrame:
    """Inner join where two nulls match, with an optional further predicate."""
    condition = reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])
    return left.join(right, condition if residual is None else condition & residual)


def join_star(
    fact: DataFrame, dimensions: Sequence[tuple[DataFrame, dict[str, str]]]
) -> DataFrame:
    """Join a fact table to dimensions, each given with {fact key: dimension key}."""
    for dimension, keys in dimensions:
        on = [F.col(a) == F.col(b) for a, b in keys.items()]
        fact = fact.join(dimension, reduce(lambda a, b: a & b, on))
    return fact


def join_unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `left` without a partner."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def self_join_counts(
    df: DataFrame, key: str, left_predicate: str, right_predicate: str, name: str = "n"
) -> DataFrame:
    """Row count per key of a self equi-join with one-sided predicates.

    Every left row meets every right row of its key, so the count is a product
    of two counts: one scan and one aggregation, no join, and a hot key costs
    no more than its rows.
    """
    sides = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if(F.expr(left_predicate)).alias("_left"),
        F.count_if(F.expr(right_predicate)).alias("_right"),
    )
    total = F.col("_left") * F.col("_right")
    return sides.filter((F.col("_left") > 0) & (F.col("_right") > 0)).select(
        key, total.alias(name)
    )


def pair_counts(df: DataFrame, group: str, item: str) -> DataFrame:
    """Unordered pairs of rows inside each group: all, equal items, unequal items.

    The numbers follow from the item counts, so no pair is ever emitted.
    """
    per_item = df.groupBy(group, item).agg(F.count("*").alias("_n"))
    rows = F.sum("_n")
    equal = F.sum(F.expr("_n * (_n - 1) div 2"))
    return (
        per_item.groupBy(group)
        .agg(rows.alias("_rows"), equal.alias("equal_pairs"))
        .withColumn("pairs", F.expr("_rows * (_rows - 1) div 2"))
        .withColumn("unequal_pairs", F.col("pairs") - F.col("equal_pairs"))
        .select(group, "pairs", "equal_pairs", "unequal_pairs")
    )
