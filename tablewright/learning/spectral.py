"""The largest eigenvectors of X'X without X'X: singular vectors and principal components.

A block Krylov space grows by one aggregate a step: every task adds up
X'(XV) of its rows for a narrow block V.  The driver holds the space, some
multiples of columns times k numbers, and never columns squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import ArrowUDFType

#: Columns of a block beyond those wanted, blocks held before the space is cut back, and steps at most.
SPARE, BLOCKS, STEPS = 4, 12, 300


def product(df: DataFrame, values: str, block: np.ndarray, centre: np.ndarray | None = None) -> np.ndarray:
    """X'(X block) of an array column in one aggregate, the rows taken from `centre`; null rows add nothing."""
    sent = df.sparkSession.sparkContext.broadcast((block, centre))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, middle = sent.value
        total = np.zeros(wide.shape)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(wide))
                x = x if middle is None else x - middle
                total += x.T @ (x @ wide)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = df.select(F.col(values).cast("array<double>").alias("v")).where("v is not null").mapInArrow(partial, "i long, row array<double>")
    found = rows.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect()  # one narrow row per column
    total = np.zeros(block.shape)
    for r in found:
        total[r["i"]] = r["row"]
    sent.unpersist()
    return total


def independent(block: np.ndarray, space: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `block` adds to the orthonormal columns of `space`."""
    size = np.linalg.norm(block, axis=0, keepdims=True)
    rest = block / np.where(size > 0, size, 1)
    for _ in range(2):
        rest = rest - space @ (space.T @ rest)
    left, singular, _ = np.linalg.svd(rest, full_matrices=False)
    fresh = left[:, singular > 1e-10]
    return fresh - space @ (space.T @ fresh)


def largest(multiply: Callable[[np.ndarray], np.ndarray], dimensions: int, k: int, tolerance: float = 1e-9, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix and their vectors, as columns; it is known by its products alone.

    Ends when no residual is above `tolerance` times the largest value, or
    when the space is the whole one.  The sign of a vector makes its largest
    entry positive.
    """
    k = min(k, dimensions)
    width = min(dimensions, k + SPARE)
    rng = np.random.default_rng(seed)
    space, images = np.zeros((dimensions, 0)), np.zeros((dimensions, 0))
    block = independent(rng.standard_normal((dimensions, width)), space)
    for _ in range(STEPS):
        space, images = np.hstack([space, block]), np.hstack([images, multiply(block)])
        inner = space.T @ images
        squares, turn = np.linalg.eigh((inner + inner.T) / 2)
        squares, turn = squares[::-1], turn[:, ::-1]
        rest = images @ turn[:, :width] - space @ turn[:, :width] * squares[:width]
        if np.linalg.norm(rest[:, :k], axis=0).max() <= tolerance * max(abs(squares[0]), 1e-300) or space.shape[1] >= dimensions:
            break
        if space.shape[1] + width > max(BLOCKS * width, 2 * width):
            space, images = space @ turn[:, : 2 * width], images @ turn[:, : 2 * width]
        block = independent(rest, space)
        if not block.shape[1]:
            # Equal values hide behind each other: go on in a fresh direction.
            block = independent(rng.standard_normal((dimensions, width)), space)
        block = block[:, : dimensions - space.shape[1]]
        if not block.shape[1]:
            break
    inner = space.T @ images
    squares, turn = np.linalg.eigh((inner + inner.T) / 2)
    vectors = space @ turn[:, ::-1][:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return squares[::-1][:k], vectors * np.where(signs == 0, 1, signs)


def singular_values(df: DataFrame, values: str, dimensions: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values and their right vectors, as columns."""
    squares, vectors = largest(lambda block: product(df, values, block), dimensions, k)
    rounding = dimensions * np.finfo(float).eps * max(float(squares[0]), 0.0)  # below it a square is 0
    return np.sqrt(np.where(squares > rounding, squares, 0.0)), vectors


def turned(spark: SparkSession, values: Column, matrix: np.ndarray) -> Column:
    """An array column as row vectors times a matrix, which goes to the tasks once and not into the plan; null for null."""
    sent = spark.sparkContext.broadcast(matrix)

    def times(column: pa.Array) -> pa.Array:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        given = column.drop_null()
        rows = given.flatten().to_numpy(zero_copy_only=False).reshape(len(given), -1) @ sent.value if len(given) else np.zeros((0, 0))
        at = np.cumsum(known) - 1
        return pa.array([rows[i] if k else None for i, k in zip(at, known)], pa.list_(pa.float64()))

    return F.arrow_udf(times, "array<double>", functionType=ArrowUDFType.SCALAR)(values.cast("array<double>"))


@dataclass
class PrincipalComponents:
    """Directions of most variance, as columns, and their shares of all variance."""

    components: np.ndarray
    explained: np.ndarray

    def transform(self, df: DataFrame, values: str, output: str = "pca") -> DataFrame:
        """Coordinates of each row, taken as it stands and not from the mean, as an array; null for a null row."""
        return df.withColumn(output, turned(df.sparkSession, F.col(values), self.components))


def principal_components(df: DataFrame, values: str, k: int) -> PrincipalComponents:
    """The k directions of most variance of an array column whose rows have equal lengths; null rows are left out."""
    rows = df.select(F.col(values).cast("array<double>").alias("v")).where("v is not null")
    if rows.isEmpty():
        raise ValueError("no rows to take components of")
    found = rows.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("v")).alias("s")).select("s.mean", "s.variance", "s.count").first()
    centre, spread = found["mean"].toArray(), float(found["variance"].toArray().sum()) * (found["count"] - 1)
    squares, vectors = largest(lambda block: product(rows, "v", block, centre), len(centre), k)
    return PrincipalComponents(vectors, np.clip(squares, 0, None) / spread if spread else np.zeros(len(squares)))
