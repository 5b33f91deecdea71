"""The shared folder for intermediate tables, and cutting lineage through it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_records: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` of the session.

    Where it is unset, a session inside one process takes a folder of its
    warehouse; on a cluster there is no safe guess, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) for a location, through the session's Hadoop settings."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh location in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    filesystem, target = hadoop_path(spark, path)
    filesystem.deleteOnExit(target)
    for record in _records:
        record.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch locations handed out inside the block, to be removed once nothing reads them."""
    paths: list[str] = []
    _records.append(paths)
    try:
        yield paths
    finally:
        # By identity: two empty records are equal.
        _records[:] = [record for record in _records if record is not paths]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a location of the shared folder once nothing reads it any more."""
    filesystem, target = hadoop_path(spark, path)
    filesystem.delete(target, True)


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` to the shared folder once and go on from the written table.

    Later stages then survive lost executors without recomputing what led
    here, and non-deterministic columns are fixed for every later reader.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut_lineage` wrote, once what was made of them is written too.

    Only the very DataFrame that `cut_lineage` gave back names its table; any
    other is left alone.
    """
    for table in tables:
        path = table.__dict__.get("scratch_path")
        if path:
            remove(table.sparkSession, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside the block, what a written table's shuffles left on disk goes once the table is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan of fewer tasks than cores, for costly row work.

    Meant for a plain scan, before text is split.  A table of many files has
    more tasks than the cluster has cores and is left as it is.
    """
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df  # already shuffled somewhere, and counting its tasks would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = execution.toRdd().getNumPartitions()
    return df.repartition(cores) if tasks < cores else df
