"""Rows that used to be lost off the tested path: null keys, null values, unknown points, large means."""

from __future__ import annotations

import pytest

from tablewright.analysis.hypothesis import chi_square_goodness, ks_custom
from tablewright.analysis.sampling import hash_split
from tablewright.operators.aggregates import collect_group
from tablewright.streaming.learners import StreamingWelchTest, merged_moments


def test_null_keys_go_to_training(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    train, test = hash_split(df, "k", 0.5)
    assert train.count() + test.count() == 3 and train.where("k is null").count() == 1


def test_null_values_stay_in_groups(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, None)], "k long, v long")
    assert {r["k"]: r["values"] for r in collect_group(df, "k", "v").collect()} == {1: [None, 5], 2: [None]}


def test_unknown_points_are_errors(spark):
    sample = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    with pytest.raises(Exception, match="not in the table"):
        ks_custom(sample, "x", spark.createDataFrame([(1.0, 0.5)], "value double, probability double")).collect()
    with pytest.raises(Exception, match="not expected"):
        chi_square_goodness(sample, "x", spark.createDataFrame([(1.0, 1.0)], "x double, weight double")).collect()


def test_variance_at_large_means():
    test = StreamingWelchTest()
    for label, *moments in [(True, 3, 1e9 + 1, 2.0), (True, 3, 1e9 + 3, 2.0), (False, 2, 1e9, 2.0)]:
        test.sides[label] = merged_moments(test.sides[label], tuple(moments))
    (n_a, mean_a, m2_a), (n_b, _, m2_b) = test.sides[True], test.sides[False]
    assert (mean_a, m2_a / (n_a - 1), m2_b / (n_b - 1)) == (1e9 + 2, pytest.approx(2.0), pytest.approx(2.0))
