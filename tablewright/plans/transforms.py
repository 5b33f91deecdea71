"""The five column transforms a plan is made of, and their registry."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.operators.columns import replace_with_constant
from tablewright.operators.filters import filter_not_null
from tablewright.operators.ordering import sort_all_columns

# A column is put on a log scale when its variance is above this.
LOG_VARIANCE = 100.0


@dataclass(frozen=True)
class Setting:
    """What transforms need beyond the chosen columns."""

    variances: Mapping[str, float] = field(default_factory=dict)
    nullable: frozenset[str] = frozenset()
    constant: Any = 0
    sort: bool = True


Transform = Callable[[DataFrame, Sequence[str], Setting], DataFrame]
TRANSFORMS: dict[str, Transform] = {}


def transform(name: str):
    """Register a transform; plans apply them in name order."""

    def register(function: Transform) -> Transform:
        TRANSFORMS[name] = function
        return function

    return register


def transform_names() -> list[str]:
    return sorted(TRANSFORMS)


def conditional_log(
    df: DataFrame,
    columns: Sequence[str],
    variances: Mapping[str, float],
    above: float = LOG_VARIANCE,
) -> DataFrame:
    """Natural log of the chosen double columns whose variance is large.

    Variance is looked up by name.  The log of a number that is not positive
    is null.
    """
    chosen = [
        f.name
        for f in df.schema.fields
        if f.name in columns
        and isinstance(f.dataType, T.DoubleType)
        and variances.get(f.name, 0.0) > above
    ]
    return df.withColumns({c: F.when(F.col(c) > 0, F.ln(c)) for c in chosen}) if chosen else df


def type_default(data_type: T.DataType):
    """The value that stands for null: 0, 0.0, "" or 1970-01-01."""
    if isinstance(data_type, T.NumericType):
        return F.lit(0).cast(data_type)
    if isinstance(data_type, T.StringType):
        return F.lit("")
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(data_type)
    return None


def fill_nulls_by_type(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null becomes the default of the column's type in the chosen columns."""
    filled = {}
    for f in df.schema.fields:
        default = type_default(f.dataType)
        if f.name in columns and default is not None:
            filled[f.name] = F.coalesce(F.col(f.name), default)
    return df.withColumns(filled) if filled else df


@transform("trans1")
def drop_null_rows(df: DataFrame, columns: Sequence[str], setting: Setting) -> DataFrame:
    return filter_not_null(df, columns)


@transform("trans2")
def constant_columns(df: DataFrame, columns: Sequence[str], setting: Setting) -> DataFrame:
    """Replace the first chosen column by a constant."""
    return replace_with_constant(df, columns[0], setting.constant) if columns else df


@transform("trans3")
def log_columns(df: DataFrame, columns: Sequence[str], setting: Setting) -> DataFrame:
    return conditional_log(df, columns, setting.variances)


@transform("trans4")
def fill_columns(df: DataFrame, columns: Sequence[str], setting: Setting) -> DataFrame:
    return fill_nulls_by_type(df, columns)


@transform("trans5")
def sorted_rows(df: DataFrame, columns: Sequence[str], setting: Setting) -> DataFrame:
    """Sort by all columns, where row order matters to the caller."""
    return sort_all_columns(df) if setting.sort else df
