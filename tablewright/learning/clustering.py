"""Clusters, topics, factorisations and recommendations."""

from __future__ import annotations

import numpy as np
from pyspark.ml import clustering as mlc
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.learning.spectral import turned


def kmeans(df: DataFrame, k: int = 2, max_iter: int = 20, seed: int = 1) -> mlc.KMeansModel:
    return mlc.KMeans(k=k, maxIter=max_iter, seed=seed).fit(df)


def bisecting_kmeans(df: DataFrame, k: int = 2, seed: int = 1) -> mlc.BisectingKMeansModel:
    return mlc.BisectingKMeans(k=k, seed=seed).fit(df)


def gaussian_mixture(df: DataFrame, k: int = 2, seed: int = 1) -> mlc.GaussianMixtureModel:
    return mlc.GaussianMixture(k=k, seed=seed).fit(df)


def recommender(
    df: DataFrame,
    user: str = "user",
    item: str = "item",
    rating: str = "rating",
    max_iter: int = 5,
    reg: float = 0.01,
    seed: int = 1,
) -> ALSModel:
    """Implicit-feedback factorisation; unknown users and items are dropped
    from predictions rather than scored NaN."""
    learner = ALS(
        userCol=user,
        itemCol=item,
        ratingCol=rating,
        maxIter=max_iter,
        regParam=reg,
        implicitPrefs=True,
        coldStartStrategy="drop",
        seed=seed,
    )
    return learner.fit(df)


def left_vectors(
    df: DataFrame, values: str, singular: np.ndarray, right: np.ndarray, output: str = "u"
) -> DataFrame:
    """Rows of U = X V / s; a null row has none.

    The matrix goes to the tasks once, not into the plan; a singular value of
    zero has zeros.
    """
    scaled = right * np.divide(1.0, singular, out=np.zeros_like(singular), where=singular > 0)
    return df.withColumn(output, turned(df.sparkSession, F.col(values), scaled))


def components(model: mlc.GaussianMixtureModel) -> DataFrame:
    """(component, weight, mean, covariance) of a mixture, the matrix by rows."""
    rows = [
        (i, float(w), g.mean.toArray().tolist(), g.cov.toArray().tolist())
        for i, (w, g) in enumerate(zip(model.weights, model.gaussians))
    ]
    spark = SparkSession.active()
    return spark.createDataFrame(
        rows, "component int, weight double, mean array<double>, covariance array<array<double>>"
    )


def centres(model: mlc.KMeansModel | mlc.BisectingKMeansModel) -> DataFrame:
    """(cluster, centre) of a fitted model."""
    rows = [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]
    return SparkSession.active().createDataFrame(rows, "cluster int, centre array<double>")
