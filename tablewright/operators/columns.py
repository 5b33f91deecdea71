"""Operators that change a table's columns rather than its rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def replace_with_constant(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Drop a column and append it again, last, as a constant."""
    return df.drop(column).withColumn(column, F.lit(value))


def replace_with(df: DataFrame, column: str, derived: Column) -> DataFrame:
    """Drop a column and append its derived form, last, under the old name."""
    rest = [F.col(name) for name in df.columns if name != column]
    return df.select(*rest, derived.alias(column))


def clean_name(name: str) -> str:
    return re.sub(r"[ +]", "_", name.strip())


def sanitize_names(df: DataFrame) -> DataFrame:
    """Trim column names; blanks and plus signs become underscores."""
    return df.toDF(*[clean_name(name) for name in df.columns])


def drop_by_position(df: DataFrame, position: int) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for i, n in enumerate(df.columns) if i != position])


def model_columns(
    columns: Sequence[str], targets: Sequence[str], features: Sequence[str]
) -> dict[str, list[str]]:
    """Targets and features present in the table, and their complements."""
    chosen = [c for c in targets if c in columns]
    used = [c for c in features if c in columns and c not in chosen]
    return {
        "targets": chosen,
        "features": used,
        "targets_left": [c for c in columns if c not in chosen],
        "features_left": [c for c in columns if c not in used],
    }
