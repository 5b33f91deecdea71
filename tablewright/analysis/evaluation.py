"""Model quality from predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.ordering import running_total


def regression_errors(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean squared error and its root."""
    error = F.col(label) - F.col(prediction)
    mse = F.avg(error * error)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def classification_scores(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Accuracy, test error and label-weighted precision."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(
        F.count("*").alias("n")
    )
    # One row per pair of classes from here on.
    hits = F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0))
    by_label = cells.groupBy(F.col("l").alias("class")).agg(F.sum("n").alias("labels"))
    by_prediction = cells.groupBy(F.col("p").alias("class")).agg(
        F.sum("n").alias("predicted"), hits.alias("right")
    )
    per_class = by_label.join(by_prediction, "class", "left").fillna(0, ["predicted", "right"])
    precision = F.coalesce(F.try_divide(F.col("right"), F.col("predicted")), F.lit(0.0))
    accuracy = F.sum("right") / F.sum("labels")
    return per_class.agg(
        accuracy.alias("accuracy"),
        (1 - accuracy).alias("test_error"),
        (F.sum(precision * F.col("labels")) / F.sum("labels")).alias("weighted_precision"),
    )


def area_under_roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, exact, ties counting half.

    Scores are counted per class first; a distributed running total then
    gives the negatives below every distinct score.
    """
    per_score = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    running = running_total(per_score, ["score"], "neg", "upto")
    below = F.col("upto") - F.col("neg") / 2
    wins = F.sum(F.col("pos") * below)
    return running.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.withColumn("residual", F.col(label) - F.col(prediction))
