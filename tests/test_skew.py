"""A key that holds a third of all rows is split across tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.functions import features as ft
from tablewright.operators import filters, joins, ordering

SMALL_LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def small_limits(spark):
    """Limits at which a test-sized partition counts as skewed."""
    before = {k: spark.conf.get(k, None) for k in SMALL_LIMITS}
    for key, value in SMALL_LIMITS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture
def hot(spark):
    """300,000 rows, a third of them with key 0."""
    return spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("k"),
        F.xxhash64("id").alias("payload"),
    )


@pytest.fixture
def keys(spark):
    return spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_inner_join(spark, small_limits, hot, keys):
    out = joins.join_pairs(hot, keys, "k")
    assert out.count() == 300_000
    assert "skew=true" in final_plan(out)


def test_join_under_an_aggregate_on_the_same_key(spark, small_limits, hot, keys):
    out = joins.join_pairs(hot, keys, "k").groupBy("k").agg(F.count("payload").alias("n"))
    assert "skew=true" in final_plan(out)
    assert out.agg(F.sum("n")).first()[0] == 300_000


def test_semi_and_anti_join(spark, small_limits, hot, keys):
    semi = filters.filter_keys(hot, keys.filter("k < 500").select("k"), "k")
    anti = joins.join_unmatched(hot, keys.filter("k >= 500"), ["k"])
    assert semi.count() == anti.count()
    assert "skew=true" in final_plan(semi)
    assert "skew=true" in final_plan(anti)


def test_category_codes_of_a_hot_value(spark, small_limits, hot):
    out = ft.index_column(hot.select("k"), "k", "code")
    first = out.filter("k = 0").agg(F.min("code"), F.max("code"), F.count("*")).first()
    assert (first[0], first[1]) == (0.0, 0.0) and first[2] > 100_000
    assert "skew=true" in final_plan(out)


def test_equal_rows_are_numbered_on_many_tasks(spark):
    rows = spark.range(0, 100_000, 1, 8).select(F.lit(7).alias("v"), F.rand(0).alias("_tie"))
    out = ordering.numbered(rows, ["v", "_tie"], name="n", start=0)
    stats = out.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert tuple(stats) == (0, 99_999, 100_000)
