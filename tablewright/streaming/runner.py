"""Opening file streams and running them to a table in the shared folder."""

from __future__ import annotations

import datetime
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.storage import hadoop_path, scratch_path


def text_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New text files of a folder, line by line, as a stream."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder)


def parquet_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    glob: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """The event time as an instant, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def run_to_table(
    stream: DataFrame,
    label: str,
    checkpoint: str | None = None,
    target: str | None = None,
    seen: Counter | None = None,
) -> DataFrame:
    """Run an append stream over all present input; return what the target holds.

    Files are committed per batch, so a restart with the same checkpoint and
    target, which belong together, neither loses nor repeats rows.  `seen`
    gains the run's batches, rows and late rows, see `count_progress`.
    """
    if (checkpoint is None) != (target is None):
        raise ValueError("a checkpoint and its target are given together")
    spark = stream.sparkSession
    target = target or scratch_path(spark, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if seen is not None:
        count_progress(query, seen)
    return spark.read.schema(stream.schema).parquet(target)


def count_progress(query: StreamingQuery, seen: Counter) -> None:
    """Add a query's batches, input rows, and the rows its windows dropped as late.

    Late rows are counted where they are dropped, behind the partial
    aggregation of a batch: rows of one window and key count once a task.
    """
    for progress in query.recentProgress:
        seen["batches"] += 1
        seen["rows"] += progress["numInputRows"]
        seen["late_rows"] += sum(o["numRowsDroppedByWatermark"] for o in progress["stateOperators"])


#: Event time of the row that ends an input: behind any window's end.
END_OF_INPUT = datetime.datetime(9000, 1, 1)


def run_to_end(
    source: DataFrame,
    time: str,
    build: Callable[[DataFrame], DataFrame],
    label: str,
    checkpoint: str | None = None,
    target: str | None = None,
    seen: Counter | None = None,
) -> DataFrame:
    """Run `build(source)` as `run_to_table` does, then close the windows still open.

    For input that has ended.  The source is read together with a folder of
    our own.  Once all input is read, that folder gets one row without values
    at END_OF_INPUT, which moves the watermark past every window of the
    input: they all come out.  The row's own windows never close, so it is in
    no result.  Rows that come later under the same checkpoint are late.
    """
    if (checkpoint is None) != (target is None):
        raise ValueError("a checkpoint and its target are given together")
    spark = source.sparkSession
    target = target or scratch_path(spark, label)
    checkpoint = checkpoint or scratch_path(spark, f"{label}-checkpoint")
    ends = f"{checkpoint}-end"
    filesystem, path = hadoop_path(spark, ends)
    filesystem.mkdirs(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in source.schema.fields])
    stream = build(source.unionByName(parquet_stream(spark, ends, schema)))
    run_to_table(stream, label, checkpoint, target, seen)
    end = [None if f.name != time else END_OF_INPUT for f in schema.fields]
    spark.createDataFrame([tuple(end)], schema).coalesce(1).write.mode("append").parquet(ends)
    return run_to_table(stream, label, checkpoint, target, seen)


def run_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    label: str,
    checkpoint: str | None = None,
    stop_when: Callable[[], bool] | None = None,
) -> None:
    """Hand every micro-batch to `handle`, until input ends or `stop_when`."""
    spark = stream.sparkSession
    stopped = {"yes": False}

    def step(batch: DataFrame, batch_id: int) -> None:
        if stopped["yes"]:
            return
        handle(batch, batch_id)
        if stop_when is not None and stop_when():
            stopped["yes"] = True

    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    if stop_when is None:
        query.awaitTermination()
        return
    while not query.awaitTermination(1):
        if stopped["yes"]:
            query.stop()
            return


def each_batch_table(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    label: str,
    schema: T.StructType | str,
) -> DataFrame:
    """Transform every micro-batch by itself; the results carry `batch_id`.

    A batch overwrites its own folder, so running it again after a failure
    leaves one copy.
    """
    spark = stream.sparkSession
    target = scratch_path(spark, label)
    filesystem, path = hadoop_path(spark, target)
    filesystem.mkdirs(path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    run_batches(stream, handle, label)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(full).option("basePath", target).parquet(target)
