"""The rule ensemble: what is compiled equals what was fitted, statistics by hand, held-out accuracy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import rule_ensemble as re_


def stats(spark, text):
    return re_.statistics(spark.createDataFrame([(text,)], "text string")).first().asDict()


def test_statistics_by_hand(spark):
    got = stats(spark, "The cat the CAT cat!\n\nThe  dog ### 12.\nThe  dog ### 12.")
    assert got["log_words"] == pytest.approx(math.log(14))
    assert got["letters_per_word"] == pytest.approx(27 / 13)
    assert got["upper_share"] == pytest.approx(6 / 27)
    assert got["distinct_word_share"] == pytest.approx(6 / 13)  # the cat cat! dog ### 12.
    assert got["distinct_line_share"] == pytest.approx(2 / 3)
    assert got["word_again_share"] == 0 and got["longest_word"] == 4
    assert got["function_word_share"] == pytest.approx(4 / 13)
    assert got["exclamations_per_word"] == pytest.approx(1 / 13)
    assert got["words_per_line"] == pytest.approx(13 / 3)
    assert stats(spark, "aa aa aa b")["word_again_share"] == pytest.approx(2 / 4)
    for empty in (None, "", " \n"):
        assert set(stats(spark, empty).values()) <= {0.0}


def prose(rng, n):
    return " ".join(rng.choice(["word", "other", "the", "of", "thing", "running", "house"]) + rng.choice(["", "", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(600):
        text = prose(rng, rng.randint(5, 60))
        good = i % 4 != 0
        if not good:
            text = [text.replace(" ", " ### "), text.upper() + "!!", (text.split()[0] + " ") * 40][i // 4 % 3]
        rows.append((i, text, 1, "s"))
        marks.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, log_words string"), spark.createDataFrame(marks, "doc_id long, quality int")


def test_held_out_rows_are_told_apart(labelled):
    docs, marks = labelled
    got = re_.quality(docs, marks).join(marks, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and 80 < len(held) < 160
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


def test_compiled_rules_score_as_fitted(spark, labelled):
    docs, marks = labelled
    table, y = re_.sample(docs, marks, "doc_id", "text", "quality", 5, 300)
    assert len(y) == 300
    model = re_.fit(table, y)
    assert 0 < len(model.rules) < 200 and all(1 <= len(r) <= re_.DEPTH for r in model.rules)
    logit = model.intercept + sum(w * re_.fires(r, table) for r, w in zip(model.rules, model.weights))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(*[table[n] for n in re_.STATISTICS]))], "i int, " + ", ".join(f"{n} double" for n in re_.STATISTICS))
    got = [r.s for r in rows.select("i", model.score().alias("s")).orderBy("i").collect()]
    assert got == pytest.approx(list(1 / (1 + np.exp(-logit))))


def test_lasso_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x = np.column_stack([(rng.random((400, 12)) < 0.4).astype(float), np.ones(400)])
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1])))).astype(float)
    for penalty in (0.002, 0.02, 0.2):
        w = re_.lasso(x, y, penalty, np.zeros(13))
        slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / 400
        assert abs(slope[-1]) < 1e-5
        for k in range(12):
            assert abs(slope[k] + penalty * np.sign(w[k])) < 1e-5 if w[k] else abs(slope[k]) <= penalty + 1e-5


def test_paths_hold_where_they_lead():
    rng = np.random.default_rng(1)
    table = {"a": rng.random(200), "b": rng.integers(0, 4, 200).astype(float)}
    y = ((table["a"] > 0.5) & (table["b"] <= 1)).astype(float)
    cuts = {"a": np.linspace(0.1, 0.9, 9), "b": np.array([0.5, 1.5, 2.5])}
    nodes = list(re_.grow(table, cuts, np.arange(200), y - y.mean(), np.full(200, 0.2)))
    assert nodes
    for path, rows, _ in nodes:
        assert np.flatnonzero(re_.fires(path, table)).tolist() == rows.tolist()
    a = re_.Condition("a", 0.2, True)
    assert re_.tidy((a, re_.Condition("a", 0.6, True), re_.Condition("b", 2.5, False))) == (re_.Condition("a", 0.6, True), re_.Condition("b", 2.5, False))


def test_edges(spark, labelled):
    docs, marks = labelled
    odd = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, ""), (3, "x" * 300_000), (4, "a " * 100_000)], "doc_id long, text string")
    got = re_.quality(odd, marks.limit(0)).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1), (4, None), (None, 0), (99, 0)], "doc_id long, quality int")
    got = re_.quality(odd, ones).collect()
    assert len({r.score for r in got}) == 1 and got[0].score > 0.5
    assert re_.quality(docs.limit(0), marks).count() == 0
    many = re_.quality(odd.unionByName(docs.select("doc_id", "text")), marks)
    assert many.count() == 606 and many.where(F.col("score").isNull()).count() == 0
