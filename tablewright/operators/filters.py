"""Row filters, kept as column expressions so that they reach the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

# Longer key lists become a table and a semi join instead of a literal set.
MAX_LITERAL_KEYS = 1000


def filter_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in any of `columns`; all rows if none is chosen."""
    return df.na.drop(how="any", subset=list(columns)) if columns else df


def filter_not_equal(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Rows whose column differs from `value`; ``"null"`` means not null."""
    if value is None or value == "null":
        return df.filter(F.col(column).isNotNull())
    return df.filter(F.col(column) != F.lit(value))


def filter_threshold_sort(df: DataFrame, column: str, above: Any) -> DataFrame:
    """Rows above a constant, sorted by the same column."""
    return df.filter(F.col(column) > F.lit(above)).orderBy(column)


def filter_optional_value(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Rows equal to an optional value; None selects the null rows."""
    return df.filter(F.col(column).eqNullSafe(F.lit(value)))


def filter_keys(
    df: DataFrame, keys: DataFrame | Iterable, columns: str | Sequence[str]
) -> DataFrame:
    """Rows whose key is in another table or in a list of values.

    A table becomes a left semi join whose strategy Spark picks by size; its
    keys are never collected.  A short list is a literal set that scans can
    push down; an empty list keeps no row.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    if isinstance(keys, DataFrame):
        # Distinct keys combine on the map side and arrive partitioned for the join.
        return df.join(keys.select(*names).distinct(), names, "left_semi")
    values = list(keys)
    if not values:
        return df.filter(F.lit(False))
    if len(values) > MAX_LITERAL_KEYS:
        rows = [(v,) if len(names) == 1 else tuple(v) for v in values]
        schema = df.select(*names).schema
        return filter_keys(df, df.sparkSession.createDataFrame(rows, schema), names)
    if len(names) == 1:
        return df.filter(F.col(names[0]).isin(values))
    matches = [
        reduce(lambda a, b: a & b, [F.col(n) == F.lit(v) for n, v in zip(names, value)])
        for value in values
    ]
    return df.filter(reduce(lambda a, b: a | b, matches))


def lookup_in_list(df: DataFrame, group: str, groups: Iterable, wanted: str) -> DataFrame:
    """The `wanted` ids whose group id is in a list."""
    return filter_keys(df, groups, group).select(wanted)
