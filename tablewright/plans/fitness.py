"""How well a plan's table can be modelled: five models on four column levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import regression as mlr
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tablewright.analysis.evaluation import classification_scores, regression_errors
from tablewright.functions.features import index_strings, label_features, normalize, scale_minmax
from tablewright.functions.scalars import label_parity, label_thirds, values_text
from tablewright.learning.classification import indexed, perceptron, text_classifier
from tablewright.operators.columns import model_columns

# Weight of each column level, narrowest choice first.
LEVEL_WEIGHTS = (4, 3, 2, 1)
# An error at or above this does not count.
ERROR_LIMIT = 0.5

Fitness = Callable[[DataFrame, int], float | None]


def _rmse(learner, data: DataFrame, weights: Sequence[float], seed: int) -> float | None:
    train, test = data.randomSplit(list(weights), seed)
    if train.isEmpty() or test.isEmpty():
        return None
    return regression_errors(learner.fit(train).transform(test)).first()["rmse"]


def tree_error(data: DataFrame, seed: int) -> float | None:
    """RMSE of a regression tree."""
    learner = indexed(mlr.DecisionTreeRegressor(seed=seed), 20)
    return _rmse(learner, data, (0.7, 0.3), seed)


def text_error(data: DataFrame, seed: int) -> float | None:
    """RMSE of two classes predicted from the features read as words."""
    words = data.select(
        label_parity(F.col("label")).cast("double").alias("label"),
        values_text(vector_to_array("features")).alias("text"),
    )
    return _rmse(text_classifier(buckets=1000, max_iter=100, reg=0.01), words, (0.7, 0.3), seed)


def perceptron_error(data: DataFrame, seed: int) -> float | None:
    """Test error of a small network on three classes."""
    thirds = data.withColumn("label", label_thirds(F.col("label")).cast("double"))
    scaled = scale_minmax(thirds, "features").select("label", F.col("scaled").alias("features"))
    first = scaled.first()
    if first is None:
        return None
    train, test = scaled.randomSplit([0.6, 0.4], seed)
    if train.isEmpty() or test.isEmpty():
        return None
    model = perceptron([first["features"].size, 5, 4, 3]).fit(train)
    return classification_scores(model.transform(test)).first()["test_error"]


def forest_error(data: DataFrame, seed: int) -> float | None:
    """RMSE of a random forest."""
    return _rmse(indexed(mlr.RandomForestRegressor(seed=seed), 20), data, (0.7, 0.3), seed)


def boosted_error(data: DataFrame, seed: int) -> float | None:
    """RMSE of boosted trees on rows scaled to L1 norm 1."""
    normed = normalize(data, "features", 1.0).select("label", F.col("normed").alias("features"))
    learner = indexed(mlr.GBTRegressor(maxIter=10, maxBins=128, seed=seed), 100)
    return _rmse(learner, normed, (0.7, 0.3), seed)


FITNESS: dict[str, Fitness] = {
    "tree": tree_error,
    "text": text_error,
    "perceptron": perceptron_error,
    "forest": forest_error,
    "boosted": boosted_error,
}


@dataclass(frozen=True)
class Level:
    targets: tuple[str, ...]
    features: tuple[str, ...]
    weight: int


def column_levels(
    columns: Sequence[str], targets: Sequence[str], objects: Sequence[str]
) -> list[Level]:
    """The four choices of target and feature columns, from the wanted ones to the rest."""
    lists = model_columns(columns, targets, objects)
    rest = [c for c in lists["targets_left"] if c not in lists["features"]]
    choices = [
        (lists["targets"], lists["features"]),
        (lists["targets"], lists["features_left"]),
        (rest, lists["features"]),
        (lists["targets_left"], lists["features_left"]),
    ]
    return [Level(tuple(t), tuple(f), w) for (t, f), w in zip(choices, LEVEL_WEIGHTS)]


@dataclass(frozen=True)
class LevelResult:
    weight: int
    errors: dict[str, float | None]

    @property
    def best(self) -> float | None:
        """Smallest error below the limit, or None."""
        found = [e for e in self.errors.values() if e is not None and e == e]
        return min(found) if found and min(found) < ERROR_LIMIT else None


def score(results: Sequence[LevelResult]) -> float | None:
    """Sum of the valid errors over (sum of their weights) ** 1.5; smaller is
    better, None if no level is valid."""
    valid = [(r.best, r.weight) for r in results if r.best is not None and r.best > 0]
    if not valid:
        return None
    return sum(e for e, _ in valid) / sum(w for _, w in valid) ** 1.5


def plan_fitness(
    table: DataFrame,
    levels: Sequence[Level],
    seed: int = 1234,
    models: Sequence[str] = tuple(FITNESS),
    at_once: int = 8,
) -> list[LevelResult]:
    """Errors of all models on all levels of a plan's table.

    The table is indexed and kept once; every level is a projection of it,
    and the models run side by side as separate Spark jobs.
    """
    coded = index_strings(table).persist(StorageLevel.MEMORY_AND_DISK)
    kept = []
    try:
        coded.count()
        tasks = []
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            for level in levels:
                usable = model_columns(coded.columns, level.targets, level.features)
                if not usable["targets"] or not usable["features"]:
                    tasks.append((level, {}))
                    continue
                data = label_features(coded, level.targets, level.features)
                data = data.persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(data)
                tasks.append((level, {m: pool.submit(_attempt, FITNESS[m], data, seed) for m in models}))
        return [
            LevelResult(level.weight, {m: job.result() for m, job in jobs.items()})
            for level, jobs in tasks
        ]
    finally:
        for data in [*kept, coded]:
            data.unpersist()


def _attempt(fitness: Fitness, data: DataFrame, seed: int) -> float | None:
    """A model's error, or None where its table cannot be modelled at all:
    no rows, or a split left without rows."""
    if not data.take(1):
        return None
    return fitness(data, seed)
