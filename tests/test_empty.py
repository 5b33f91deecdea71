"""Operators on tables and folders without rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.analysis import evaluation, hypothesis, sampling, summary
from tablewright.functions import features as ft, text
from tablewright.learning import regression as rg
from tablewright.operators import aggregates, joins, ordering, patterns
from tablewright.storage import hadoop_path, scratch_path
from tablewright.streaming import learners, metrics, runner


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "k string, v int, w int")


@pytest.fixture
def no_files(spark):
    folder = scratch_path(spark, "empty")
    filesystem, path = hadoop_path(spark, folder)
    filesystem.mkdirs(path)
    return folder


def test_positions_of_nothing(nothing):
    assert ordering.numbered(nothing, ["v"]).collect() == []
    assert ordering.running_total(nothing, ["v"], "w").collect() == []


def test_groups_of_nothing(nothing):
    assert aggregates.collect_group(nothing, "k", "v").collect() == []
    assert aggregates.rate_table(nothing, "k", "v > 0").collect() == []
    assert joins.pair_counts(nothing, "k", "v").collect() == []
    assert joins.self_join_counts(nothing, "k", "v > 0", "w > 0").collect() == []


def test_statistics_of_nothing(nothing):
    assert summary.spearman(nothing, "v", "w").first()[0] is None
    assert evaluation.area_under_roc(nothing, "v", "w").first()[0] is None
    assert evaluation.regression_errors(nothing, "v", "w").first()["mse"] is None
    assert hypothesis.welch_test(nothing.withColumn("b", F.col("v") > 0), "b", "w").first()["t"] is None
    assert sampling.sample_strata_exact(nothing, "k", {"a": 0.5}, "v").collect() == []


def test_encoders_of_nothing(nothing):
    assert ft.category_codes(nothing, "k").collect() == []
    assert ft.exact_quantiles(nothing, "v", 3) == []
    assert ft.index_strings(nothing).collect() == []
    assert text.clean_tokens(nothing, "v", "k").collect() == []
    assert text.tfidf(text.title_token_rows(nothing, "v", "k"), "v", nothing).collect() == []


def test_baskets_of_nothing(nothing):
    assert patterns.baskets(nothing, "v", "k", 0.5).collect() == []
    assert patterns.mine_sequences(nothing, "k", ["v"], "w", 0.5).collect() == []


def test_streams_without_files(spark, no_files):
    words = metrics.words_of(runner.text_stream(spark, no_files), "value")
    assert metrics.running_counts(metrics.batch_counts(words, "word"), "word").collect() == []
    assert runner.run_to_table(runner.text_stream(spark, no_files), "none").collect() == []


def test_learners_without_batches(spark, no_files):
    schema = spark.createDataFrame([], "label boolean, value double").schema
    stream = runner.parquet_stream(spark, no_files, schema)
    out = learners.StreamingWelchTest().run(stream, "label", "value").first()
    assert (out["t"], out["batches"]) == (None, 0)
    model = learners.StreamingLinearRegression(["value"], label="y")
    wide = spark.createDataFrame([], "y double, value double").schema
    assert model.train_on(runner.parquet_stream(spark, no_files, wide)).collect() == []
    assert list(model.weights) == [0.0]


def test_an_isotonic_fit_of_one_level(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert [tuple(r) for r in rg.isotonic_table(rg.isotonic(df, "x", "y")).collect()] == [(1.0, 3.0)]
