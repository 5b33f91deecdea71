"""File writers that put a finished result in place of an old one."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.storage import hadoop_path


def csv_line(df: DataFrame, name: str = "line") -> DataFrame:
    """Each row as one comma-joined line; null is written as ``null``."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in df.columns]
    return df.select(F.concat_ws(",", *cells).alias(name))


def _swap_in(spark: SparkSession, fresh: str, target: str) -> None:
    """Rename the finished output over the old one, which is kept until then."""
    filesystem, new = hadoop_path(spark, fresh)
    _, final = hadoop_path(spark, target)
    _, old = hadoop_path(spark, f"{target}.old-{uuid.uuid4().hex}")
    had_old = filesystem.exists(final)
    if had_old:
        filesystem.rename(final, old)
    if not filesystem.rename(new, final):
        if had_old:
            filesystem.rename(old, final)
        raise OSError(f"could not move {fresh} to {target}")
    if had_old:
        filesystem.delete(old, True)


def write_csv(df: DataFrame, target: str) -> None:
    """Write a folder of CSV parts with headers and swap it in over an existing target.

    Between the two renames of the swap there is no target.
    """
    spark = df.sparkSession
    fresh = f"{target}.new-{uuid.uuid4().hex}"
    df.write.csv(fresh, header=True)
    _swap_in(spark, fresh, target)


def write_single_csv(df: DataFrame, target: str) -> None:
    """Write one CSV file, the header once, in the order of the table's partitions, in place of what the target holds.

    All tasks write their parts; then the parts' bytes are copied one after
    another into a file beside the target, a buffer at a time, and that file
    is renamed over the target.  Until the rename the old file can be read.
    A folder in the target's place is moved away first.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fresh = f"{target}.new-{uuid.uuid4().hex}"
    parts, head = f"{fresh}-parts", f"{fresh}-head"
    filesystem, whole = hadoop_path(spark, fresh)
    try:
        df.write.csv(parts)
        names = spark.createDataFrame([tuple(df.columns)], ", ".join(f"c{i} string" for i in range(len(df.columns))))
        names.coalesce(1).write.csv(head)
        out = filesystem.create(whole, False)
        try:
            for folder in (head, parts):
                found = filesystem.listStatus(hadoop_path(spark, folder)[1])
                files = sorted((f.getPath() for f in found if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
                for file in files:
                    source = filesystem.open(file)
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                    finally:
                        source.close()
        finally:
            out.close()
        _, final = hadoop_path(spark, target)
        if filesystem.exists(final) and filesystem.getFileStatus(final).isDirectory():
            _swap_in(spark, fresh, target)
            return
        options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(filesystem.getUri(), conf)
        context.rename(filesystem.makeQualified(whole), filesystem.makeQualified(final), options)
    finally:
        for leftover in (parts, head, fresh):
            filesystem.delete(hadoop_path(spark, leftover)[1], True)


def write_many(
    frames: Mapping[str, DataFrame],
    targets: Mapping[str, str],
    default: DataFrame,
    at_once: int = 4,
) -> None:
    """Write named tables to their targets, several jobs at a time; a target
    whose table is missing gets the default table."""

    def write_one(name: str) -> None:
        write_csv(frames.get(name, default), targets[name])

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        list(pool.map(write_one, targets))


def write_lines(spark: SparkSession, lines: Sequence[str], target: str) -> None:
    """Write a short list of lines as text."""
    fresh = f"{target}.new-{uuid.uuid4().hex}"
    table = spark.createDataFrame([(line,) for line in lines], "value string")
    table.coalesce(1).write.text(fresh)
    _swap_in(spark, fresh, target)


def prediction_lines(df: DataFrame, prediction: str, line: Column | None = None) -> DataFrame:
    """Predictions as text, after their input line where one is given."""
    shown = F.col(prediction).cast("string")
    value = shown if line is None else F.concat_ws(" ", line, shown)
    return df.select(value.alias("value"))


def write_predictions(
    df: DataFrame, target: str, prediction: str, line: Column | None = None
) -> None:
    prediction_lines(df, prediction, line).write.mode("overwrite").text(target)
