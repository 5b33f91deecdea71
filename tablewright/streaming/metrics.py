"""Metrics over event-time windows and joins of streams with tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.streaming.runner import each_batch_table


def batch_counts(stream: DataFrame, key: str, label: str = "counts") -> DataFrame:
    """Rows per key in each micro-batch."""
    key_type = stream.schema[key].dataType.simpleString()
    return each_batch_table(
        stream.select(key),
        lambda batch: batch.groupBy(key).agg(F.count("*").alias("n")),
        label,
        f"{key} {key_type}, n long",
    )


def running_counts(counts: DataFrame, key: str) -> DataFrame:
    """Counts over all batches so far, from the per-batch counts."""
    return counts.groupBy(key).agg(F.sum("n").alias("n"))


def words_of(stream: DataFrame, text: str) -> DataFrame:
    """Blank-separated words of a text stream."""
    return stream.select(F.explode(F.split(text, " ", -1)).alias("word"))


def _windowed(stream: DataFrame, time: str, window: str, slide: str, delay: str):
    return stream.withWatermark(time, delay), F.window(time, window, slide)


def _bounds() -> list[Column]:
    return [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]


def sliding_counts(
    stream: DataFrame, time: str, key: str, window: str, slide: str, delay: str
) -> DataFrame:
    """Rows per key in sliding windows; a window is emitted once it is closed."""
    marked, span = _windowed(stream, time, window, slide, delay)
    counts = marked.groupBy(span.alias("window"), key).agg(F.count("*").alias("n"))
    return counts.select(*_bounds(), key, "n")


def error_rates(
    stream: DataFrame,
    time: str,
    key: str,
    is_error: Column,
    window: str,
    slide: str,
    delay: str,
    limit: float = 0.05,
) -> DataFrame:
    """Share of errors per key in sliding windows, flagged above a limit."""
    marked, span = _windowed(stream, time, window, slide, delay)
    rates = marked.groupBy(span.alias("window"), key).agg(
        F.avg(F.when(is_error, 1.0).otherwise(0.0)).alias("rate")
    )
    return rates.select(*_bounds(), key, "rate", (F.col("rate") > limit).alias("flagged"))


def active_users(
    stream: DataFrame, time: str, user: str, window: str, slide: str, delay: str
) -> DataFrame:
    """Distinct users in sliding windows.

    Users are grouped per window first and counted second, so the state is
    spread over users and no set of all users is ever built.
    """
    marked, span = _windowed(stream, time, window, slide, delay)
    seen = marked.groupBy(span.alias("window"), user).agg(F.count("*").alias("n"))
    return seen.groupBy("window").agg(F.count("*").alias("users")).select(*_bounds(), "users")


def join_known(stream: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stream rows joined with a table."""
    return stream.join(table, key)


def drop_listed(stream: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Stream rows whose key is not in a table."""
    return stream.join(listed.select(key), key, "left_anti")
