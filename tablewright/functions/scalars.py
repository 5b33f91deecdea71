"""Scalar expressions, all built-in and JVM side but for the two UDF helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Text restored after form encoding, as browsers write it.
URI_RESTORED = {
    "+": "%20",
    "%21": "!",
    "%27": "'",
    "%28": "(",
    "%29": ")",
    "%7E": "~",
}


def encode_uri_component(text: Column) -> Column:
    """Percent-encode text the way browsers encode a URI component."""
    encoded = F.url_encode(text)
    for old, new in URI_RESTORED.items():
        encoded = F.replace(encoded, F.lit(old), F.lit(new))
    return encoded


def page_view(line: Column) -> list[Column]:
    """Typed fields of a tab-separated page view: url, status, zip code, user."""
    fields = F.split(line, "\t", -1)
    return [
        fields[0].alias("url"),
        fields[1].cast("int").alias("status"),
        fields[2].cast("int").alias("zip_code"),
        fields[3].cast("int").alias("user_id"),
    ]


def season(month: Column) -> Column:
    """Northern season of a month number."""
    return (
        F.when(month.between(3, 5), "Spring")
        .when(month.between(6, 8), "Summer")
        .when(month.between(9, 11), "Autumn")
        .otherwise("Winter")
    )


def date_parts(stamp: Column) -> dict[str, Column]:
    """Calendar columns of a timestamp; weeks are ISO, days count from Monday = 1."""
    weekday = F.weekday(stamp) + 1
    return {
        "Year": F.year(stamp),
        "Month": F.month(stamp),
        "Day": F.dayofmonth(stamp),
        "WeekNum": F.weekofyear(stamp),
        "HourOfDay": F.hour(stamp),
        "Weekend": F.when(weekday >= 6, 1).otherwise(0),
        "Season": season(F.month(stamp)),
        "WeekDay": weekday,
    }


def refine_date(
    df: DataFrame, column: str, pattern: str = "MM/dd/yyyy hh:mm:ss a", zone: str = "UTC"
) -> DataFrame:
    """Replace a text timestamp by its calendar columns in `zone`.

    The text is local time of `zone`, so its parts need no conversion; the
    zone only fixes the instant, which `to_utc_timestamp` adds as `instant`.
    """
    local = F.try_to_timestamp(F.col(column), F.lit(pattern))
    refined = df.withColumns(date_parts(local))
    return refined.withColumn("instant", F.to_utc_timestamp(local, zone)).drop(column)


def reformat_date(text: Column) -> Column:
    """``yyyyMMdd`` to ``yyyy/MM/dd``."""
    parts = [F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)]
    return F.concat_ws("/", *parts)


def label_parity(value: Column) -> Column:
    """Two classes from a number: parity of its whole part."""
    return F.abs(value.cast("long")) % 2


def label_thirds(value: Column) -> Column:
    """Three classes from a number."""
    return F.abs(value.cast("long")) * 10 % 3


def values_text(values: Column) -> Column:
    """Array of numbers as blank-separated words."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ")


def natural_log(value: Column) -> Column:
    """ln of a positive number, else null."""
    return F.when(value > 0, F.ln(value))


def membership_udf(values: Iterable) -> Callable[[Column], Column]:
    """A user function testing membership in a small set, in Arrow batches.

    Kept to show the user-function surface; `filter_keys` does the same
    inside the JVM.
    """
    wanted = frozenset(values)

    @F.pandas_udf("boolean")
    def contained(column: pd.Series) -> pd.Series:
        return column.isin(wanted)

    return contained


def pair_membership_udf(values: Iterable[tuple]) -> Callable[[Column, Column], Column]:
    """Membership of a two-column key in a small set, in Arrow batches."""
    wanted = pd.MultiIndex.from_tuples(list(values))

    @F.pandas_udf("boolean")
    def contained(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(pd.MultiIndex.from_arrays([first, second]).isin(wanted))

    return contained


def map_rows(df: DataFrame, change: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Apply a schema-preserving function to Arrow batches of rows."""

    def each_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield change(batch)

    return df.mapInPandas(each_batch, df.schema)
