"""Stratified samples and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values of the arithmetic hash: (id * 1103515245 + 12345) mod 2^31.
HASH_FACTOR, HASH_SHIFT, HASH_RANGE = 1103515245, 12345, 2**31
_BUCKETS = 1024


def arithmetic_hash(key: Column) -> Column:
    """A hash of an integer id that any SQL engine can repeat."""
    small = F.pmod(key.cast("long"), F.lit(HASH_RANGE).cast("long"))
    return F.pmod(small * F.lit(HASH_FACTOR).cast("long") + HASH_SHIFT, F.lit(HASH_RANGE).cast("long"))


def sample_strata(
    df: DataFrame, key: str, fractions: Mapping, seed: int | None = None
) -> DataFrame:
    """Keep about the given fraction of each stratum, in one pass."""
    return df.sampleBy(key, dict(fractions), seed)


def sample_strata_exact(
    df: DataFrame, key: str, fractions: Mapping, unique_id: str
) -> DataFrame:
    """Keep exactly ceil(fraction * n) rows of each stratum, chosen by id hash.

    Rows fall into 1024 hash ranges per stratum.  Range counts decide which
    ranges are kept whole; only the one range that crosses the quota is
    sorted, so a stratum holding most of the table still spreads out.
    """
    cases = F.lit(None).cast("double")
    for value, fraction in fractions.items():
        cases = F.when(F.col(key) == F.lit(value), F.lit(float(fraction))).otherwise(cases)
    hashed = df.filter(F.col(key).isin(list(fractions))).withColumn(
        "_hash", arithmetic_hash(F.col(unique_id))
    )
    ranged = hashed.withColumn(
        "_range", F.floor(F.col("_hash") / F.lit(HASH_RANGE // _BUCKETS)).cast("int")
    )
    # At most 1024 rows per stratum from here on.
    counts = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    upto = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quotas = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_quota", F.ceil(cases * F.sum("_n").over(whole)))
        .withColumn("_left", F.col("_quota") - (F.col("_upto") - F.col("_n")))
        .filter(F.col("_left") > 0)
        .select(key, "_range", "_n", "_left")
    )
    joined = ranged.join(quotas, [key, "_range"])
    kept = joined.filter(F.col("_left") >= F.col("_n"))
    place = F.row_number().over(Window.partitionBy(key, "_range").orderBy("_hash", unique_id))
    crossing = (
        joined.filter(F.col("_left") < F.col("_n"))
        .withColumn("_place", place)
        .filter(F.col("_place") <= F.col("_left"))
        .drop("_place")
    )
    return kept.unionByName(crossing).select(*df.columns)


def random_split(df: DataFrame, weights: Sequence[float], seed: int) -> list[DataFrame]:
    return df.randomSplit(list(weights), seed)


def hash_split(
    df: DataFrame, key: str, train_share: float
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by id hash: repeatable, whatever the partitioning.

    Rows without a key go to the training part.
    """
    border = int(train_share * HASH_RANGE)
    train = F.coalesce(arithmetic_hash(F.col(key)) < F.lit(border), F.lit(True))
    return df.filter(train), df.filter(~train)
