"""Hypothesis tests whose statistics come from grouped counts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import ArrowUDFType

from tablewright.operators.ordering import running_total


def chi_square_independence(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Pearson's statistic and degrees of freedom of a contingency table.

    Empty cells need not be listed: the statistic equals
    n * (sum(o^2 / (row total * column total)) - 1).
    """
    cells = df.groupBy(F.col(feature).alias("f"), F.col(label).alias("l")).agg(
        F.count("*").alias("o")
    )
    rows = cells.groupBy("f").agg(F.sum("o").alias("r"))
    columns = cells.groupBy("l").agg(F.sum("o").alias("c"))
    share = F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c")))
    return cells.join(rows, "f").join(columns, "l").agg(
        (F.sum("o") * (share - 1)).alias("statistic"),
        ((F.count_distinct("f") - 1) * (F.count_distinct("l") - 1)).alias("df"),
    )


def chi_square_test(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Statistic, degrees of freedom and p-value of every slot against a label."""
    return ChiSquareTest.test(df, vector, label, flatten=True)


def chi_square_goodness(
    df: DataFrame, category: str, expected: DataFrame | None = None
) -> DataFrame:
    """Category counts against a uniform or given distribution.

    `expected` has columns (category, weight); every category of it counts,
    also one that was never observed.
    """
    counts = df.groupBy(category).agg(F.count("*").cast("double").alias("o"))
    if expected is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        wanted = expected.select(F.col(category), F.col("weight").cast("double").alias("w"))
        unknown = F.raise_error(F.lit("an observed category is not expected")).cast("double")
        weighted = wanted.join(counts, category, "full").select(F.coalesce("o", F.lit(0.0)).alias("o"), F.coalesce("w", unknown).alias("w"))
    # sum((o - e)^2 / e) with e = N * w / W equals W / N * sum(o^2 / w) - N.
    n, w = F.sum("o"), F.sum("w")
    return weighted.agg(
        (w / n * F.sum(F.col("o") * F.col("o") / F.col("w")) - n).alias("statistic"),
        (F.count("*") - 1).alias("df"),
    )


def normal_probability(value: Column, mean: float, deviation: float) -> Column:
    """The normal distribution function, which Spark does not have: half the complementary error function."""
    scale = deviation * math.sqrt(2)

    def below(column: pa.Array) -> pa.Array:
        values = column.to_numpy(zero_copy_only=False)
        return pa.array([0.5 * math.erfc((mean - v) / scale) for v in values], pa.float64())

    return F.arrow_udf(below, "double", functionType=ArrowUDFType.SCALAR)(value)


def kolmogorov_p(statistic: float, n: int) -> float:
    """Probability that n draws lie at least that far from their own distribution.

    Exact up to EXACT_N draws, by the power of a matrix whose size follows
    n * statistic; the limiting series beyond, with its corrections in 1 / n.
    """
    if not n or math.isnan(statistic):
        return math.nan
    if statistic * n <= 0.5:
        return 1.0
    if statistic >= 1:
        return 0.0
    if n <= EXACT_N:
        return min(1.0, max(0.0, 1.0 - _kolmogorov_exact(statistic, n)))
    x = statistic * math.sqrt(n)
    x += 1 / (6 * math.sqrt(n)) + (x - 1) / (4 * n)
    if x < 0.3:
        return 1.0
    total = sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


#: Draws up to which the Kolmogorov distribution is taken exactly.
EXACT_N = 1000


def _kolmogorov_exact(statistic: float, n: int) -> float:
    """P(D_n < statistic) = n! / n^n times the middle entry of H^n, H of size 2k - 1 with k = ceil(n * statistic)."""
    k = math.ceil(n * statistic)
    m, h = 2 * k - 1, k - n * statistic
    i, j = np.indices((m, m))
    matrix = (i - j + 1 >= 0).astype(float)
    powers = h ** np.arange(1, m + 1)
    matrix[:, 0] -= powers
    matrix[-1, :] -= powers[::-1]
    if 2 * h > 1:
        matrix[-1, 0] += (2 * h - 1) ** m
    matrix /= np.array([math.factorial(max(d, 0)) for d in range(m + 1)], float)[np.clip(i - j + 1, 0, m)]
    power, exponent, result, shift = matrix, 0, np.eye(m), 0
    left = n
    while left:
        if left & 1:
            result, shift = result @ power, shift + exponent
            result, shift = _scaled(result, shift)
        power, exponent = _scaled(power @ power, 2 * exponent)
        left >>= 1
    log_value = math.log(max(result[k - 1, k - 1], 1e-300)) + shift * math.log(2) + math.lgamma(n + 1) - n * math.log(n)
    return math.exp(min(log_value, 0.0))


def _scaled(matrix: np.ndarray, exponent: int) -> tuple[np.ndarray, int]:
    """The matrix over a power of two, so that high powers neither overflow nor vanish."""
    top = float(matrix.max())
    if 1e-100 < top < 1e100 or top <= 0:
        return matrix, exponent
    by = math.frexp(top)[1]
    return matrix * 2.0**-by, exponent + by


def ks_normal(df: DataFrame, column: str, mean: float = 0.0, deviation: float = 1.0) -> DataFrame:
    """One-sample Kolmogorov-Smirnov test against a normal distribution: pValue, statistic.

    Nulls are left out; without values both are null.  Values are counted
    first and accumulated by a distributed running total.
    """
    if deviation is None or not deviation > 0:
        raise ValueError("the deviation of a normal distribution is positive")
    sample = df.select(F.col(column).cast("double").alias("value")).where("value is not null")
    steps, n = _steps(sample, "value")
    farthest = steps.withColumn("probability", normal_probability(F.col("value"), float(mean), float(deviation)))
    found = _farthest(farthest, n).first()
    row = (None, None) if found["statistic"] is None else (kolmogorov_p(found["statistic"], found["n"]), found["statistic"])
    return df.sparkSession.createDataFrame([row], "pValue double, statistic double")


def _steps(df: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """(value, _n, _upto) for each distinct value, and how many there are in all."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("_n"))
    steps = running_total(counts, ["value"], "_n", "_upto")
    return steps, steps.agg(F.max("_upto")).scalar()


def _farthest(steps: DataFrame, n: Column) -> DataFrame:
    """One row: the largest distance of the steps from `probability`, above or below, and the sample's size n."""
    above = F.col("_upto") / n - F.col("probability")
    below = F.col("probability") - (F.col("_upto") - F.col("_n")) / n
    return steps.agg(F.max(F.greatest(above, below)).alias("statistic"), F.max("_upto").alias("n"))


def ks_custom(df: DataFrame, column: str, cdf: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov statistic against a table (value, probability).

    Values are counted, accumulated by a distributed running total and joined
    with the table; a sample value that is not in the table is an error.
    """
    steps, n = _steps(df, column)
    unknown = F.raise_error(F.lit("a sample value is not in the table of the distribution")).cast("double")
    steps = steps.join(cdf, "value", "left").withColumn("probability", F.coalesce(F.col("probability").cast("double"), unknown))
    return _farthest(steps, n).select("statistic")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return value


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if math.isnan(t) or df <= 0:
        return math.nan
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def welch_columns() -> dict:
    """t and degrees of freedom from (n, mean, variance) of two samples."""
    error_a, error_b = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    error = error_a + error_b
    spread = error_a * error_a / (F.col("n_a") - 1) + error_b * error_b / (F.col("n_b") - 1)
    return {
        "t": F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(error)),
        "df": F.try_divide(error * error, spread),
    }


def welch_test(df: DataFrame, label: str, value: str) -> DataFrame:
    """Welch's two-sample t statistic; sample a is where the label is true."""
    aggregates = []
    for side, keep in (("a", F.col(label)), ("b", ~F.col(label))):
        kept = F.when(keep, F.col(value))
        aggregates += [
            F.count(kept).alias(f"n_{side}"),
            F.avg(kept).alias(f"mean_{side}"),
            F.var_samp(kept).alias(f"var_{side}"),
        ]
    return df.agg(*aggregates).withColumns(welch_columns())
