"""Classifiers, each as fit on one table and scores on another."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as mlc
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, Tokenizer, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F


def logistic(
    df: DataFrame,
    max_iter: int = 100,
    reg: float = 0.0,
    threshold: float = 0.5,
    probability: str = "probability",
) -> mlc.LogisticRegressionModel:
    """Binary logistic regression with the usual knobs given at fit time."""
    learner = mlc.LogisticRegression()
    settings = {
        learner.maxIter: max_iter,
        learner.regParam: reg,
        learner.threshold: threshold,
        learner.probabilityCol: probability,
    }
    return learner.fit(df, settings)


def text_classifier(
    text: str = "text", buckets: int = 1000, max_iter: int = 100, reg: float = 0.01
) -> Pipeline:
    """White-space words, hashed counts, logistic regression."""
    words = Tokenizer(inputCol=text, outputCol="words")
    counts = HashingTF(numFeatures=buckets, inputCol="words", outputCol="features")
    return Pipeline(stages=[words, counts, mlc.LogisticRegression(maxIter=max_iter, regParam=reg)])


def indexed(learner: Estimator, max_categories: int = 4) -> Pipeline:
    """A tree learner behind an indexer of the categorical slots."""
    indexer = VectorIndexer(
        inputCol="features",
        outputCol="indexedFeatures",
        maxCategories=max_categories,
        handleInvalid="keep",
    )
    learner.setFeaturesCol("indexedFeatures")
    return Pipeline(stages=[indexer, learner])


def decision_tree(max_categories: int = 4, seed: int = 0) -> Pipeline:
    return indexed(mlc.DecisionTreeClassifier(seed=seed), max_categories)


def random_forest(trees: int = 10, max_categories: int = 4, seed: int = 0) -> Pipeline:
    return indexed(mlc.RandomForestClassifier(numTrees=trees, seed=seed), max_categories)


def boosted_trees(
    rounds: int = 10, depth: int = 6, max_categories: int = 4, seed: int = 0
) -> Pipeline:
    return indexed(mlc.GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed), max_categories)


def perceptron(
    layers: Sequence[int], max_iter: int = 100, block: int = 128, seed: int = 1234
) -> mlc.MultilayerPerceptronClassifier:
    return mlc.MultilayerPerceptronClassifier(
        layers=list(layers), maxIter=max_iter, blockSize=block, seed=seed
    )


def one_vs_rest(max_iter: int = 10, tol: float = 1e-6) -> mlc.OneVsRest:
    base = mlc.LogisticRegression(maxIter=max_iter, tol=tol, fitIntercept=True)
    return mlc.OneVsRest(classifier=base, parallelism=4)


def naive_bayes(smoothing: float = 1.0) -> mlc.NaiveBayes:
    return mlc.NaiveBayes(smoothing=smoothing, modelType="multinomial")


def naive_bayes_tables(model: mlc.NaiveBayesModel) -> list[tuple[int, int, float, float]]:
    """(class, slot, pi, theta) of a fitted model: classes x slots numbers."""
    pi, theta = model.pi.toArray(), model.theta.toArray()
    return [
        (c, s, float(pi[c]), float(theta[c][s]))
        for c in range(theta.shape[0])
        for s in range(theta.shape[1])
    ]


def linear_svm(max_iter: int = 100, reg: float = 0.0) -> mlc.LinearSVC:
    return mlc.LinearSVC(maxIter=max_iter, regParam=reg)


def sparse_svm(
    df: DataFrame, max_iter: int = 100, reg: float = 0.1, step: float = 1.0, tol: float = 1e-3
) -> np.ndarray:
    """Weights of a linear SVM with an L1 penalty, by proximal gradient descent.

    The vector's slots are kept as columns, so each iteration is one generated
    aggregation over the cached rows: the slots of all rows inside the margin
    are summed with their side.  The step shrinks with the square root of the
    iteration, and descent ends once the weights barely move.
    """
    first = df.select("features").first()
    slots = [f"_s{i}" for i in range(first["features"].size if first else 0)]
    side = F.when(F.col("label") > 0, 1.0).otherwise(-1.0).alias("_side")
    values = vector_to_array("features")
    kept = df.select(side, *[values[i].alias(s) for i, s in enumerate(slots)]).persist()
    weights = np.zeros(len(slots))
    try:
        for i in range(1, max_iter + 1):
            score = F.lit(0.0)
            for slot, weight in zip(slots, weights):
                score = score + F.col(slot) * F.lit(float(weight))
            inside = F.col("_side") * score < 1
            sums = kept.agg(
                F.count("*").alias("n"),
                *[F.sum(F.when(inside, -F.col("_side") * F.col(s))).alias(s) for s in slots],
            ).first()
            gradient = np.array([sums[s] or 0.0 for s in slots]) / max(sums["n"], 1)
            size = step / np.sqrt(i)
            moved = weights - size * gradient
            moved = np.sign(moved) * np.maximum(np.abs(moved) - size * reg, 0.0)
            still = np.linalg.norm(moved - weights) < tol * max(np.linalg.norm(moved), 1.0)
            weights = moved
            if i > 1 and still:
                break
        return weights
    finally:
        kept.unpersist()


def linear_scores(df: DataFrame, weights: Sequence[float], intercept: float) -> DataFrame:
    """Raw score of a linear model as a column expression over the vector."""
    terms = F.zip_with(
        vector_to_array("features"),
        F.array(*[F.lit(float(w)) for w in weights]),
        lambda x, w: x * w,
    )
    return df.withColumn("score", F.aggregate(terms, F.lit(float(intercept)), lambda a, b: a + b))


def multinomial_logistic(max_iter: int = 100, reg: float = 0.0) -> mlc.LogisticRegression:
    return mlc.LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg)


def positive_probability(scored: DataFrame, probability: str = "probability"):
    return vector_to_array(F.col(probability))[1]


def score_rows(model: PipelineModel | Transformer, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Score a batch of new rows; `flagged` is whether class 1 falls below the threshold."""
    scored = model.transform(rows)
    p = positive_probability(scored)
    return scored.withColumn("p", p).withColumn("flagged", p < F.lit(threshold))


def cross_validate_text(
    df: DataFrame,
    text: str = "text",
    buckets: Sequence[int] = (10, 100, 1000),
    regs: Sequence[float] = (0.1, 0.01),
    folds: int = 2,
    seed: int = 0,
    at_once: int = 4,
) -> tuple[DataFrame, CrossValidatorModel]:
    """Choose hash width and penalty of the text classifier by area under ROC."""
    words = Tokenizer(inputCol=text, outputCol="words")
    counts = HashingTF(inputCol="words", outputCol="features")
    learner = mlc.LogisticRegression(maxIter=10)
    grid = (
        ParamGridBuilder()
        .addGrid(counts.numFeatures, list(buckets))
        .addGrid(learner.regParam, list(regs))
        .build()
    )
    validator = CrossValidator(
        estimator=Pipeline(stages=[words, counts, learner]),
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"),
        numFolds=folds,
        seed=seed,
        parallelism=at_once,
    )
    kept = df.persist()  # read once per fold and setting
    try:
        model = validator.fit(kept)
    finally:
        kept.unpersist()
    rows = [
        (int(p[counts.numFeatures]), float(p[learner.regParam]), float(score))
        for p, score in zip(grid, model.avgMetrics)
    ]
    scores = df.sparkSession.createDataFrame(rows, "buckets int, reg double, auc double")
    return scores, model
