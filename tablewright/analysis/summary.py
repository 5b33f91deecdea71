"""Column summaries, correlations and densities."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.features import number_or_zero
from tablewright.operators.ordering import running_total
from tablewright.storage import cut_lineage


def long_form(df: DataFrame, groups: Mapping[str, Mapping[str, str]], name: str) -> DataFrame:
    """Turn one wide row into rows: {row name: {output column: wide column}}."""
    rows = [
        F.struct(F.lit(label).alias(name), *[F.col(src).alias(out) for out, src in cells.items()])
        for label, cells in groups.items()
    ]
    return df.select(F.inline(F.array(*rows)))


def summarize(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Mean, sample variance and non-zero count per value, in one pass."""
    aggregates, groups = [], {}
    for i, (label, value) in enumerate(values.items()):
        aggregates += [
            F.avg(value).alias(f"mean_{i}"),
            F.var_samp(value).alias(f"variance_{i}"),
            F.count_if(value != 0).alias(f"nonzero_{i}"),
        ]
        groups[label] = {
            "mean": f"mean_{i}",
            "variance": f"variance_{i}",
            "nonzero": f"nonzero_{i}",
        }
    return long_form(df.agg(*aggregates), groups, "column")


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return summarize(df, {c: F.col(c) for c in columns})


def table_summary(df: DataFrame) -> DataFrame:
    """Summary of every column; text and null count as 0."""
    return summarize(df, {c: number_or_zero(df, c) for c in df.columns})


def column_variances(df: DataFrame) -> dict[str, float]:
    """Sample variance by column name; one number per column."""
    return {r["column"]: r["variance"] or 0.0 for r in table_summary(df).collect()}


def correlation_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("correlation"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*rows)))


def average_ranks(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """(value, rank): ranks of counted values, equal values sharing their mean."""
    distinct = counts.groupBy(value).agg(F.sum(n).alias("_n"))
    ranked = running_total(distinct, [value], "_n", "_upto")
    return ranked.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns.

    Equal (x, y) rows are counted first, ranks are given to distinct values,
    and the correlation is weighted by the counts, so repeated values cost
    one row each.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = cut_lineage(
        pairs.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n")), "pairs"
    )
    ranks_x = average_ranks(counts, "x").withColumnRenamed("rank", "rx")
    ranks_y = average_ranks(counts, "y").withColumnRenamed("rank", "ry")
    joined = counts.join(ranks_x, "x").join(ranks_y, "y")
    # Ranks have the known mean (N + 1) / 2, so centring needs no second pass.
    middle = (counts.agg(F.sum("n")).scalar() + 1) / 2
    dx, dy = F.col("rx") - middle, F.col("ry") - middle
    covariance = F.sum(F.col("n") * dx * dy)
    spread = F.sqrt(F.sum(F.col("n") * dx * dx)) * F.sqrt(F.sum(F.col("n") * dy * dy))
    return joined.agg(F.try_divide(covariance, spread).alias("correlation"))


def kernel_density(
    df: DataFrame, column: str, points: Sequence[float], bandwidth: float
) -> DataFrame:
    """Gaussian kernel density at a few given points, in one pass."""
    norm = bandwidth * math.sqrt(2 * math.pi)
    aggregates = []
    for i, point in enumerate(points):
        z = (F.col(column) - F.lit(float(point))) / F.lit(bandwidth)
        aggregates.append((F.avg(F.exp(-z * z / 2)) / F.lit(norm)).alias(f"d{i}"))
    rows = [
        F.struct(F.lit(float(p)).alias("point"), F.col(f"d{i}").alias("density"))
        for i, p in enumerate(points)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def fit_lines(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Least-squares lines of several (x, y) column pairs, in one pass."""
    aggregates, rows = [], []
    for i, (x, y) in enumerate(pairs):
        aggregates += [F.regr_slope(y, x).alias(f"s{i}"), F.regr_intercept(y, x).alias(f"i{i}")]
        rows.append(
            F.struct(
                F.lit(x).alias("x"),
                F.lit(y).alias("y"),
                F.col(f"s{i}").alias("slope"),
                F.col(f"i{i}").alias("intercept"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def fit_plane(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Least-squares plane of y on two columns, from covariances in one pass."""
    s = df.agg(
        F.covar_samp(x1, x1).alias("s11"),
        F.covar_samp(x2, x2).alias("s22"),
        F.covar_samp(x1, x2).alias("s12"),
        F.covar_samp(x1, y).alias("s1y"),
        F.covar_samp(x2, y).alias("s2y"),
        F.avg(x1).alias("m1"),
        F.avg(x2).alias("m2"),
        F.avg(y).alias("my"),
    )
    det = F.nullif(F.expr("s11 * s22 - s12 * s12"), F.lit(0.0))
    slopes = s.withColumns(
        {
            "b1": F.expr("s22 * s1y - s12 * s2y") / det,
            "b2": F.expr("s11 * s2y - s12 * s1y") / det,
        }
    )
    return slopes.select(F.expr("my - b1 * m1 - b2 * m2").alias("intercept"), "b1", "b2")
