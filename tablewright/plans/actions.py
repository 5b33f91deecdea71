"""The action table: which rows to filter, which columns to relate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.filters import filter_not_equal


def _names(text: Column, wildcard: str) -> Column:
    """Blank-separated names; an empty list where the wildcard occurs."""
    nothing = F.array().cast("array<string>")
    return F.when(text.contains(wildcard), nothing).otherwise(F.split(text, " "))


def parse_actions(actions: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Classify action rows (target, action, object) and split their names.

    Level 1 rows filter; all others, which hold a wildcard or relate columns,
    are level 3.
    """
    first = (
        (F.col("target") != "all")
        & (F.col("action") != "related_to")
        & (F.col("object") != "any")
    )
    return actions.select(
        *keep,
        F.when(first, 1).otherwise(3).alias("level"),
        F.when(first, F.split("target", " ")).otherwise(_names(F.col("target"), "all")).alias("targets"),
        F.split("action", " ").alias("actions"),
        F.when(first, F.split("object", " ")).otherwise(_names(F.col("object"), "any")).alias("objects"),
    )


@dataclass
class Actions:
    """The parsed action table on the driver; it is written by hand and short."""

    filters: list[tuple[str, str, str]] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    objects: list[str] = field(default_factory=list)


def load_actions(actions: DataFrame) -> Actions:
    loaded = Actions()
    for row in parse_actions(actions).collect():
        if row["level"] == 1:
            loaded.filters.append((row["targets"][0], row["actions"][0], row["objects"][0]))
        else:
            loaded.targets += [n for n in row["targets"] if n not in loaded.targets]
            loaded.objects += [n for n in row["objects"] if n not in loaded.objects]
    return loaded


def apply_filters(df: DataFrame, filters: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Apply ``(target, "filter", object)`` rows: keep target != object."""
    for target, action, value in filters:
        if action == "filter":
            df = filter_not_equal(df, target, value)
    return df


def plan_matrix(chosen: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(transform, column) rows as one 0/1 column per table column."""
    flags = [F.max(F.when(F.col("column") == c, 1).otherwise(0)).alias(c) for c in columns]
    return chosen.groupBy("transform").agg(*flags)
