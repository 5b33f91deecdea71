"""Regressions trained by Spark."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml import regression as mlr
from pyspark.sql import DataFrame, functions as F

from tablewright.learning.classification import indexed
from tablewright.operators.ordering import numbered, running_total
from tablewright.storage import cut_lineage, discard


def linear(
    df: DataFrame, reg: float = 0.0, elastic: float = 0.0, max_iter: int = 100, solver: str = "auto"
) -> mlr.LinearRegressionModel:
    learner = mlr.LinearRegression(
        regParam=reg, elasticNetParam=elastic, maxIter=max_iter, solver=solver
    )
    return learner.fit(df)


def least_squares(df: DataFrame) -> mlr.LinearRegressionModel:
    """Ordinary least squares by the normal equations, one pass over the data."""
    return linear(df, solver="normal")


def lasso(df: DataFrame, reg: float = 0.01) -> mlr.LinearRegressionModel:
    return linear(df, reg=reg, elastic=1.0)


def coefficient_table(model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """(term, coefficient): one row per feature and the intercept."""
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients)]
    rows.append(("intercept", float(model.intercept)))
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def generalized(
    df: DataFrame,
    family: str = "gaussian",
    link: str = "identity",
    reg: float = 0.3,
    max_iter: int = 10,
) -> mlr.GeneralizedLinearRegressionModel:
    learner = mlr.GeneralizedLinearRegression(
        family=family, link=link, regParam=reg, maxIter=max_iter
    )
    return learner.fit(df)


def decision_tree(max_bins: int = 32, max_categories: int = 4, seed: int = 0) -> Pipeline:
    return indexed(mlr.DecisionTreeRegressor(maxBins=max_bins, seed=seed), max_categories)


def random_forest(max_categories: int = 4, trees: int = 20, seed: int = 0) -> Pipeline:
    return indexed(mlr.RandomForestRegressor(numTrees=trees, seed=seed), max_categories)


def boosted_trees(rounds: int = 10, max_categories: int = 4, seed: int = 0) -> Pipeline:
    return indexed(mlr.GBTRegressor(maxIter=rounds, seed=seed), max_categories)


def survival(
    df: DataFrame, quantiles: Sequence[float] = (0.3, 0.6), censor: str = "censor"
) -> mlr.AFTSurvivalRegressionModel:
    """Weibull survival times; `censor` is 1 where the event was seen."""
    learner = mlr.AFTSurvivalRegression(
        quantileProbabilities=list(quantiles), quantilesCol="quantiles", censorCol=censor
    )
    return learner.fit(df)


#: Blocks that one task pools at once.
POOLED_BLOCKS = 1 << 16


def pooled(table: pa.Table) -> pa.Table:
    """Neighbouring blocks (low, high, total, weight) of one stretch, pooled until their means rise."""
    rows = sorted(zip(*[table.column(n).to_pylist() for n in ("low", "high", "total", "weight")]))
    kept: list[list] = []
    for row in rows:
        kept.append(list(row))
        while len(kept) > 1 and kept[-2][2] * kept[-1][3] >= kept[-1][2] * kept[-2][3]:
            _, high, total, weight = kept.pop()
            kept[-1][1] = high
            kept[-1][2] += total
            kept[-1][3] += weight
    return pa.table([pa.array(c, pa.float64()) for c in zip(*kept)], names=["low", "high", "total", "weight"])


def isotonic(df: DataFrame, feature: str, label: str, at_once: int = POOLED_BLOCKS) -> DataFrame:
    """Monotone fit of label on one feature: (no, low, high, prediction, weight), one row for each step.

    Rows are averaged per feature value first.  Neighbours that violate the
    order are then pooled in stretches of `at_once` blocks; the next round's
    stretches begin half way between, until two rounds pool nothing.  Any
    order of pooling ends in the same steps, and no task sees more than one
    stretch.  Rows with a null are left out; equal means are one step.
    """
    values = df.select(F.col(feature).cast("double").alias("low"), F.col(label).cast("double").alias("y")).na.drop()
    levels = values.groupBy("low").agg(F.sum("y").alias("total"), F.count("*").cast("double").alias("weight"))
    blocks = cut_lineage(levels.select("low", F.col("low").alias("high"), "total", "weight"), "levels")
    size, quiet, shift = blocks.count(), 0, 0
    while size:
        placed = numbered(blocks, ["low"], name="place", start=0)
        stretches = placed.withColumn("stretch", F.floor((F.col("place") + shift) / at_once))
        fewer = stretches.groupBy("stretch").applyInArrow(pooled, "low double, high double, total double, weight double")
        fewer = cut_lineage(fewer, "levels")
        discard(blocks)
        before, size, blocks = size, fewer.count(), fewer
        if before <= at_once and not shift:
            break  # one stretch held them all
        quiet = quiet + 1 if size == before else 0
        if quiet == 2:
            break
        shift = at_once // 2 - shift if size > at_once or shift else 0
    steps = numbered(blocks, ["low"], name="no", start=1)
    return cut_lineage(steps.select("no", "low", "high", (F.col("total") / F.col("weight")).alias("prediction"), "weight"), "steps")


def isotonic_predictions(steps: DataFrame, df: DataFrame, feature: str, name: str = "prediction") -> DataFrame:
    """The rows with the fitted value: a step's own between its ends, on the line from one step to the next between
    them, the first or last beyond; null for null, and without steps.

    The step of a value is a running count of the steps that begin up to it,
    over sorted distinct values, so no value is compared with all steps.
    """
    value = F.col(feature).cast("double")
    starts = steps.select(F.col("low").alias("_x"), F.lit(1).alias("_begins"))
    asked = df.select(value.alias("_x"), F.lit(0).alias("_begins")).where("_x is not null")
    sorted_values = starts.unionByName(asked).groupBy("_x").agg(F.max("_begins").alias("_begins"))
    counted = running_total(sorted_values, ["_x"], "_begins", "_no")
    own = steps.select(F.col("no").alias("_own"), F.col("high").alias("_high"), F.col("prediction").alias("_value"))
    following = steps.select((F.col("no") - 1).alias("_own"), F.col("low").alias("_next_low"), F.col("prediction").alias("_next"))
    ends = own.join(following, "_own", "full")
    found = counted.join(ends, counted["_no"] == ends["_own"], "left")
    along = F.col("_value") + (F.col("_x") - F.col("_high")) / (F.col("_next_low") - F.col("_high")) * (F.col("_next") - F.col("_value"))
    fitted = F.when(F.col("_value").isNull(), F.col("_next")).when((F.col("_x") <= F.col("_high")) | F.col("_next").isNull(), F.col("_value")).otherwise(along)
    table = found.select(F.col("_x").alias("_found"), fitted.alias(name))
    return df.join(table, value == table["_found"], "left").drop("_found")


def isotonic_table(steps: DataFrame) -> DataFrame:
    """(boundary, prediction) pairs of the fitted step function."""
    return steps.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("boundary"), "prediction")
