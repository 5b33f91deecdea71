"""Models updated batch by batch, which go on where they stopped.

Every batch is reduced inside Spark to a few numbers (sums per cluster,
gradient terms, sample moments).  Only those reach the driver.  The state
after each batch is a version in a folder, under the batch's number: a batch
that is run again after a failure does not count twice, and a learner that is
given the folder of an earlier run takes up its last version and reads on
from that run's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import ArrowUDFType

from tablewright.analysis.hypothesis import student_p
from tablewright.storage import hadoop_path, scratch_path
from tablewright.streaming.runner import run_batches


class StateStore:
    """Small per-batch state tables under ``folder/state/batch_id=N``, beside the stream's checkpoint."""

    def __init__(self, spark: SparkSession, schema: str, folder: str | None = None):
        self.spark = spark
        self.schema = schema
        base = folder or scratch_path(spark, "state")
        self.folder, self.checkpoint = f"{base}/state", f"{base}/checkpoint"
        filesystem, path = hadoop_path(spark, self.folder)
        filesystem.mkdirs(path)

    def _exists(self, batch_id: int) -> bool:
        filesystem, path = hadoop_path(self.spark, f"{self.folder}/batch_id={batch_id}/_SUCCESS")
        return filesystem.exists(path)

    def load(self, batch_id: int) -> list | None:
        if not self._exists(batch_id):
            return None
        path = f"{self.folder}/batch_id={batch_id}"
        return self.spark.read.schema(self.schema).parquet(path).collect()

    def latest(self) -> list | None:
        """The last version that was written whole, or None."""
        filesystem, path = hadoop_path(self.spark, self.folder)
        names = [status.getPath().getName() for status in filesystem.listStatus(path)]
        numbers = sorted((int(n.split("=")[1]) for n in names if n.startswith("batch_id=")), reverse=True)
        return next((self.load(n) for n in numbers if self._exists(n)), None)

    def save(self, batch_id: int, rows: list) -> None:
        table = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.folder}/batch_id={batch_id}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch_id long").parquet(self.folder)


class _Learner:
    """What the learners share: versions of their state, and taking them up again."""

    SCHEMA: str

    def update(self, batch: DataFrame) -> None:
        raise NotImplementedError

    def rows(self) -> list:
        raise NotImplementedError

    def restore(self, rows: list) -> None:
        raise NotImplementedError

    def learn(self, stream: DataFrame, label: str, folder: str | None, stop_when: Callable[[], bool] | None = None) -> StateStore:
        """Update on every batch the folder has no version of yet."""
        store = StateStore(stream.sparkSession, self.SCHEMA, folder)
        last = store.latest()
        if last is not None:
            self.restore(last)
            if stop_when is not None and stop_when():
                return store

        def handle(batch: DataFrame, batch_id: int) -> None:
            done = store.load(batch_id)
            if done is not None:
                self.restore(done)
                return
            self.update(batch)
            store.save(batch_id, self.rows())

        run_batches(stream, handle, label, store.checkpoint, stop_when)
        return store


# --- clusters ---------------------------------------------------------------


#: Rows, and row and centre pairs, that are compared at once.
BLOCK_ROWS, BLOCK_PAIRS = 4096, 1 << 21


def as_matrix(values: pa.Array) -> np.ndarray:
    """Rows of an array column, none of them null, all of one length."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of each point's nearest centre, ties to the first.

    Distances come from one matrix product a block; where others lie within
    its rounding error of the least, they are taken again as sums of squares.
    """
    found = np.empty(len(points), np.int64)
    squares = (centres * centres).sum(1)
    step = max(1, min(BLOCK_ROWS, BLOCK_PAIRS // max(len(centres), 1)))
    for at in range(0, len(points), step):
        x = points[at : at + step]
        far = squares - 2 * (x @ centres.T)
        least = far.min(1)
        error = 1e-12 * ((x * x).sum(1) + squares.max() + 1) * x.shape[1]
        close = far <= (least + error)[:, None]
        found[at : at + step] = far.argmin(1)
        for row in np.flatnonzero(close.sum(1) > 1):
            some = np.flatnonzero(close[row])
            found[at + row] = some[((centres[some] - x[row]) ** 2).sum(1).argmin()]
    return found


def nearest_centre(spark: SparkSession, values: Column, centres: np.ndarray) -> Column:
    """Index of the nearest centre; null for null.  The centres are sent to the tasks, not written into the plan."""
    sent = spark.sparkContext.broadcast(np.asarray(centres, float))

    def assign(column: pa.Array) -> pa.Array:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        indices = np.zeros(len(column), np.int64)
        indices[known] = nearest(as_matrix(column.drop_null()), sent.value)
        return pa.array(indices.astype(np.int32), pa.int32(), mask=~known)

    return F.arrow_udf(assign, "int", functionType=ArrowUDFType.SCALAR)(values.cast("array<double>"))


class StreamingKMeans(_Learner):
    """k-means whose centres move with every batch.

    With decay a, a centre c of weight n that receives m points of sum s moves
    to (c n a + s) / (n a + m), and its weight becomes n a + m.  Null points
    are left out.
    """

    SCHEMA = "cluster int, weight double, centre array<double>"

    def __init__(self, centres: Sequence[Sequence[float]], weight: float = 0.0, decay: float = 1.0):
        self.centres = np.array(centres, dtype=float)
        self.weights = np.full(len(self.centres), float(weight))
        self.decay = decay

    @classmethod
    def random(cls, k: int, dimensions: int, weight: float = 0.0, decay: float = 1.0, seed: int = 0):
        draws = np.random.default_rng(seed).standard_normal((k, dimensions))
        return cls(draws, weight, decay)

    def rows(self) -> list:
        return [
            (i, float(w), [float(x) for x in c])
            for i, (w, c) in enumerate(zip(self.weights, self.centres))
        ]

    def restore(self, rows: list) -> None:
        for row in rows:
            self.weights[row["cluster"]] = row["weight"]
            self.centres[row["cluster"]] = row["centre"]

    def update(self, batch: DataFrame, values: str | None = None) -> None:
        sent = batch.sparkSession.sparkContext.broadcast(self.centres)

        def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = sent.value
            total, count = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
            for part in batches:
                points = as_matrix(part.column(0))
                if not len(points):
                    continue
                cluster = nearest(points, centres)
                np.add.at(total, cluster, points)
                count += np.bincount(cluster, minlength=len(centres))
            # A task's sums leave it once, whatever it has read.
            got = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(got.astype(np.int32)), pa.array(count[got]), pa.array(list(total[got]), pa.list_(pa.float64()))], names=["cluster", "m", "s"]
            )

        points = batch.select(F.col(values or batch.columns[0]).cast("array<double>").alias("v")).where("v is not null")
        parts = points.mapInArrow(sums_of, "cluster int, m long, s array<double>")
        sums = parts.groupBy("cluster").agg(F.sum("m").alias("m"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
        self.weights = self.weights * self.decay
        for row in sums.collect():  # one row per cluster
            i, m = row["cluster"], row["m"]
            before = self.weights[i]
            self.centres[i] = (self.centres[i] * before + np.asarray(row["s"])) / (before + m)
            self.weights[i] = before + m

    def train_on(self, stream: DataFrame, values: str, folder: str | None = None) -> DataFrame:
        """Train on a whole stream, from where `folder` stopped; returns the state after every batch."""
        return self.learn(stream.select(values), "kmeans", folder).all()

    def predict_on(self, df: DataFrame, values: str, name: str = "cluster") -> DataFrame:
        """Cluster of each row of a table or a stream."""
        return df.withColumn(name, nearest_centre(df.sparkSession, F.col(values), self.centres))


# --- linear models ----------------------------------------------------------


def weighted_sum(columns: Sequence[str], weights: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for column, weight in zip(columns, weights):
        total = total + F.col(column) * F.lit(float(weight))
    return total


def summed_rows(batch: DataFrame, reduce_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows, none of which holds a null, of a matrix that `reduce_rows` makes of a block of them.

    A task adds up its blocks; one vector of Spark's adds up the tasks, so the
    plan is the same for any number of columns.
    """
    numbers = batch.select(*[F.col(c).cast("double") for c in batch.columns]).na.drop()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for part in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
            if len(block):
                found = np.atleast_2d(reduce_rows(block))
                sums = found if sums is None else sums + found
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(list(sums), pa.list_(pa.float64()))], names=["at", "sums"])

    parts = numbers.mapInArrow(total, "at long, sums array<double>")
    found = parts.groupBy("at").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()
    return np.array([r["sums"] for r in sorted(found, key=lambda r: r["at"])])


class _StreamingLinear(_Learner):
    """Shared batch handling of the gradient learners; put a constant column
    among the features for an intercept.  Rows with a null are left out."""

    SCHEMA = "feature string, weight double"

    def __init__(
        self,
        features: Sequence[str],
        label: str = "label",
        step: float = 0.1,
        iterations: int = 50,
        weights: Sequence[float] | None = None,
    ):
        self.features = list(features)
        self.label = label
        self.step = step
        self.iterations = iterations
        self.weights = np.zeros(len(self.features)) if weights is None else np.asarray(weights, float)

    def rows(self) -> list:
        return [(f, float(w)) for f, w in zip(self.features, self.weights)]

    def restore(self, rows: list) -> None:
        found = {r["feature"]: r["weight"] for r in rows}
        self.weights = np.asarray([found[f] for f in self.features])

    def train_on(self, stream: DataFrame, folder: str | None = None) -> DataFrame:
        """Train on a whole stream, from where `folder` stopped; returns the weights after every batch."""
        return self.learn(stream.select(self.label, *self.features), "gradient", folder).all()


class StreamingLinearRegression(_StreamingLinear):
    """Least squares by gradient descent, batch after batch.

    The gradient depends on the batch only through X'X, X'y and n, so one
    aggregation per batch serves all its iterations.
    """

    def update(self, batch: DataFrame) -> None:
        def products(block: np.ndarray) -> np.ndarray:
            whole = np.column_stack([np.ones(len(block)), block])  # 1, y, x
            return whole.T @ whole

        sums = summed_rows(batch.select(self.label, *self.features), products)
        if not len(sums):
            return
        n, moment, gram = sums[0, 0], sums[1, 2:], sums[2:, 2:]
        for i in range(1, self.iterations + 1):
            gradient = (gram @ self.weights - moment) / n
            self.weights = self.weights - self.step / np.sqrt(i) * gradient

    def predict_on(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, weighted_sum(self.features, self.weights))


class StreamingLogisticRegression(_StreamingLinear):
    """Logistic regression by gradient descent, batch after batch; each
    iteration is one aggregation over the cached batch."""

    def update(self, batch: DataFrame) -> None:
        kept = batch.select(self.label, *self.features).persist()
        try:
            for i in range(1, self.iterations + 1):
                weights = self.weights

                def gradient(block: np.ndarray, weights: np.ndarray = weights) -> np.ndarray:
                    x = block[:, 1:]
                    error = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500))) - block[:, 0]
                    return np.append(len(block), x.T @ error)

                sums = summed_rows(kept, gradient)
                if not len(sums):
                    return
                self.weights = weights - self.step / np.sqrt(i) * sums[0, 1:] / sums[0, 0]
        finally:
            kept.unpersist()

    def predict_on(self, df: DataFrame, name: str = "prediction", threshold: float = 0.5) -> DataFrame:
        p = 1 / (1 + F.exp(-weighted_sum(self.features, self.weights)))
        return df.withColumn(name, F.when(p > threshold, 1.0).otherwise(0.0))


# --- A/B test ---------------------------------------------------------------


Moments = tuple[int, float | None, float | None]


def merged_moments(a: Moments, b: Moments) -> Moments:
    """Count, mean and sum of squares about the mean of two samples together."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n


class StreamingWelchTest(_Learner):
    """Welch's t-test of true against false rows over all data so far.

    Its state is one count, mean and sum of squares a side, which takes in
    those of each batch.  Stops the stream once p falls below `level` or after
    `max_batches`.  Rows without label or value are left out.
    """

    SCHEMA = "label boolean, n long, mean double, m2 double, batches int"

    def __init__(self, level: float = 0.05, max_batches: int = 100):
        self.level = level
        self.max_batches = max_batches
        self.batches = 0
        self.sides: dict[bool, Moments] = {True: (0, None, None), False: (0, None, None)}
        self.t = self.df = None
        self.p = float("nan")

    def rows(self) -> list:
        return [(label, *moments, self.batches) for label, moments in self.sides.items()]

    def restore(self, rows: list) -> None:
        self.sides = {r["label"]: (r["n"], r["mean"], r["m2"]) for r in rows}
        self.batches = max(r["batches"] for r in rows)
        self.judge()

    def update(self, batch: DataFrame) -> None:
        values = batch.where("label is not null and value is not null")
        found = values.groupBy("label").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))
        for row in found.collect():  # two rows
            self.sides[row["label"]] = merged_moments(self.sides[row["label"]], (row["n"], row["mean"], row["m2"]))
        self.batches += 1
        self.judge()

    def judge(self) -> None:
        """t, df and p of the state."""
        (n_a, mean_a, m2_a), (n_b, mean_b, m2_b) = self.sides[True], self.sides[False]
        if n_a < 2 or n_b < 2 or not m2_a + m2_b:
            return
        error_a, error_b = m2_a / (n_a - 1) / n_a, m2_b / (n_b - 1) / n_b
        self.t = (mean_a - mean_b) / (error_a + error_b) ** 0.5
        self.df = (error_a + error_b) ** 2 / (error_a**2 / (n_a - 1) + error_b**2 / (n_b - 1))
        self.p = student_p(self.t, self.df)

    def run(self, stream: DataFrame, label: str, value: str, folder: str | None = None) -> DataFrame:
        """Test a whole stream, from where `folder` stopped; one row with t, df and p of the data seen."""
        samples = stream.select(F.col(label).alias("label"), F.col(value).cast("double").alias("value"))
        self.learn(samples, "welch", folder, stop_when=lambda: self.p < self.level or self.batches >= self.max_batches)
        p = None if self.t is None else self.p
        return stream.sparkSession.createDataFrame([(self.t, self.df, p, self.batches)], "t double, df double, p double, batches int")
