"""Statistics on the published small examples and against formulas."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.analysis import evaluation, hypothesis, sampling, summary


def test_column_summary(spark):
    df = spark.createDataFrame([(1.0, 10.0, 100.0), (2.0, 20.0, 200.0), (3.0, 30.0, 300.0)], "a double, b double, c double")
    out = {r["column"]: tuple(r)[1:] for r in summary.column_summary(df, ["a", "b", "c"]).collect()}
    assert out == {"a": (2.0, 1.0, 3), "b": (20.0, 100.0, 3), "c": (200.0, 10000.0, 3)}


def test_table_summary_counts_text_and_null_as_zero(spark):
    df = spark.createDataFrame([("x", 4, None), ("y", None, 2.0)], "s string, i int, d double")
    out = {r["column"]: tuple(r)[1:] for r in summary.table_summary(df).collect()}
    assert out == {"s": (0.0, 0.0, 0), "i": (2.0, 8.0, 1), "d": (1.0, 2.0, 1)}


def test_correlations(spark):
    x, y = [1, 2, 3, 3, 5], [11, 22, 33, 33, 555]
    df = spark.createDataFrame(list(zip(x, y)), "x int, y int")
    assert summary.correlation_pair(df, "x", "y").first()[0] == pytest.approx(statistics.correlation(x, y))
    assert summary.spearman(df, "x", "y").first()[0] == pytest.approx(1.0)


def test_spearman_with_ties(spark):
    rng = random.Random(5)
    x = [rng.randrange(8) for _ in range(80)]
    y = [a + rng.randrange(6) for a in x]

    def ranks(v):
        return [sum(o < a for o in v) + (sum(o == a for o in v) + 1) / 2 for a in v]

    df = spark.createDataFrame(list(zip(x, y)), "x int, y int")
    assert summary.spearman(df, "x", "y").first()[0] == pytest.approx(statistics.correlation(ranks(x), ranks(y)))


def test_contingency_table(spark):
    cells = {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4, (2, 0): 5, (2, 1): 6}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "f int, l int")
    n, rows, cols = 21, [3, 7, 11], [9, 12]
    expected = sum((o - rows[f] * cols[l] / n) ** 2 / (rows[f] * cols[l] / n) for (f, l), o in cells.items())
    out = hypothesis.chi_square_independence(df, "f", "l").first()
    assert (out["statistic"], out["df"]) == (pytest.approx(expected), 2)


def test_goodness_of_fit(spark):
    counts = [10, 15, 20, 30, 25]
    df = spark.createDataFrame([(i,) for i, n in enumerate(counts) for _ in range(n)], "k int")
    out = hypothesis.chi_square_goodness(df, "k").first()
    # 100 observations of shares 0.1 0.15 0.2 0.3 0.25 against 0.2 each
    assert (out["statistic"], out["df"]) == (pytest.approx(12.5), 4)


def test_goodness_counts_categories_never_seen(spark):
    df = spark.createDataFrame([("a",)] * 4, "k string")
    expected = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, weight double")
    out = hypothesis.chi_square_goodness(df, "k", expected).first()
    assert (out["statistic"], out["df"]) == (pytest.approx(4.0), 1)


def test_custom_cdf_distance(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (4,)], "x int")
    cdf = spark.createDataFrame([(1, 0.5), (2, 0.6), (4, 1.0)], "value int, probability double")
    # steps: F before/after 0/.25, .25/.75, .75/1
    assert hypothesis.ks_custom(df, "x", cdf).first()[0] == pytest.approx(0.5)


def test_normal_distance(spark):
    df = spark.createDataFrame([(0.1,), (0.15,), (0.2,), (0.3,), (0.25,)], "x double")
    out = hypothesis.ks_normal(df, "x").first()
    assert out["statistic"] == pytest.approx(0.5 * (1 + math.erf(0.1 / math.sqrt(2))))


@pytest.mark.parametrize(
    "n, statistic, p",
    [(5, 0.563, 0.05), (10, 0.409, 0.05), (10, 0.489, 0.01), (20, 0.294, 0.05), (20, 0.352, 0.01), (35, 0.224, 0.05), (1, 0.975, 0.05), (2, 0.842, 0.05)],
)
def test_published_kolmogorov_points(n, statistic, p):
    """Critical values of the one-sample test as tables print them, to three digits."""
    assert hypothesis.kolmogorov_p(statistic, n) == pytest.approx(p, rel=0.02)


def test_kolmogorov_distribution():
    # P(D_10 < 0.274) as published with the matrix method.
    assert 1 - hypothesis.kolmogorov_p(0.274, 10) == pytest.approx(0.6284796154565, abs=1e-10)
    # The limit at 1.358 root n is 5 percent; both ways agree where one takes over.
    assert hypothesis.kolmogorov_p(1.3581 / 10**5, 10**10) == pytest.approx(0.05, abs=1e-4)
    for x in (0.6, 0.9, 1.36, 1.7):
        exact = hypothesis.kolmogorov_p(x / 1000**0.5, 1000)
        assert hypothesis.kolmogorov_p(x / 1001**0.5, 1001) == pytest.approx(exact, abs=5e-4)
    assert [hypothesis.kolmogorov_p(d, 9) for d in (0.01, 1.0)] == [1.0, 0.0]
    # Two draws: both within d of where they belong, by hand 2 (2d - 1/2)^2 up to d = 1/2.
    assert 1 - hypothesis.kolmogorov_p(0.4, 2) == pytest.approx(2 * (2 * 0.4 - 0.5) ** 2)


def test_ks_statistic_by_hand(spark):
    from statistics import NormalDist

    values = [-1.2, 0.3, 0.3, 0.9, 2.5]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = hypothesis.ks_normal(df, "x", 0.5, 1.5).first()
    p = [NormalDist(0.5, 1.5).cdf(v) for v in values]
    want = max(max((i + 1) / 5 - c, c - i / 5) for i, c in enumerate(p))
    assert got["statistic"] == pytest.approx(want) and got["pValue"] == pytest.approx(hypothesis.kolmogorov_p(want, 5))
    assert tuple(hypothesis.ks_normal(df.where("x is null"), "x").first()) == (None, None)
    with pytest.raises(ValueError):
        hypothesis.ks_normal(df, "x", 0.0, 0.0)



def test_kernel_density(spark):
    data = [1, 1, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 9]
    df = spark.createDataFrame([(float(x),) for x in data], "x double")
    out = {r["point"]: r["density"] for r in summary.kernel_density(df, "x", [-1.0, 2.0, 5.0], 3.0).collect()}
    for p, d in out.items():
        expected = sum(math.exp(-((x - p) ** 2) / 18) for x in data) / (13 * 3 * math.sqrt(2 * math.pi))
        assert d == pytest.approx(expected)


def test_exact_sample_sizes_under_skew(spark):
    data = [(i, "hot" if i % 3 else "cold") for i in range(3000)] + [(9000, "rare"), (9001, "none")]
    df = spark.createDataFrame(data, "id long, k string")
    out = sampling.sample_strata_exact(df, "k", {"hot": 0.1, "cold": 0.6, "rare": 0.3}, "id")
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {"hot": 200, "cold": 600, "rare": 1}
    assert out.select("id").distinct().count() == 801


def test_exact_sample_edges(spark):
    df = spark.createDataFrame([(i, "a") for i in range(10)], "id long, k string")
    assert sampling.sample_strata_exact(df, "k", {"a": 1.0}, "id").count() == 10
    assert sampling.sample_strata_exact(df, "k", {"a": 0.0}, "id").count() == 0


def test_hash_split_is_a_partition(spark):
    df = spark.range(0, 10_000)
    train, test = sampling.hash_split(df, "id", 0.7)
    assert train.count() + test.count() == 10_000
    assert 6_500 < train.count() < 7_500
    assert train.join(test, "id").count() == 0


@pytest.mark.parametrize("t, df, p", [(0.0, 5.0, 1.0), (2.015048, 5.0, 0.1), (2.570582, 5.0, 0.05), (1.959964, 1e7, 0.05), (12.7062, 1.0, 0.05)])
def test_student_p_values(t, df, p):
    assert hypothesis.student_p(t, df) == pytest.approx(p, abs=2e-6)
    assert hypothesis.student_p(-t, df) == pytest.approx(p, abs=2e-6)


def test_welch_by_hand(spark):
    a, b = [1.0, 2.0, 4.0, 5.0], [3.0, 7.0, 8.0]
    df = spark.createDataFrame([(True, v) for v in a] + [(False, v) for v in b], "label boolean, value double")
    out = hypothesis.welch_test(df, "label", "value").first()
    ea, eb = statistics.variance(a) / 4, statistics.variance(b) / 3
    assert out["t"] == pytest.approx((statistics.mean(a) - statistics.mean(b)) / math.sqrt(ea + eb))
    assert out["df"] == pytest.approx((ea + eb) ** 2 / (ea**2 / 3 + eb**2 / 2))


def test_auc_counts_ties_half(spark):
    data = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)]
    df = spark.createDataFrame(data, "y int, s double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluation.area_under_roc(df, "y", "s").first()[0] == pytest.approx(expected)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.9)], "y int, s double")
    assert evaluation.area_under_roc(df, "y", "s").first()[0] is None


def test_classification_scores(spark):
    data = [(0, 0), (0, 0), (0, 1), (1, 1), (2, 0)]
    df = spark.createDataFrame(data, "label int, prediction int")
    out = evaluation.classification_scores(df).first()
    assert out["accuracy"] == pytest.approx(0.6)
    assert out["test_error"] == pytest.approx(0.4)
    assert out["weighted_precision"] == pytest.approx((3 * 2 / 3 + 1 * 1 / 2 + 0) / 5)


def test_fit_plane_recovers_coefficients(spark):
    rng = random.Random(2)
    rows = [(a, b, 3 + 2 * a - 5 * b) for a, b in ((rng.random(), rng.random()) for _ in range(50))]
    out = summary.fit_plane(spark.createDataFrame(rows, "a double, b double, y double"), "y", "a", "b").first()
    assert tuple(out) == pytest.approx((3.0, 2.0, -5.0))


def test_chi_square_p_of_the_small_table(spark):
    rows = [(1.0, Vectors.dense(1, 0, 3)), (1.0, Vectors.dense(1, 2, 0)), (-1.0, Vectors.dense(-1, 0, -0.5))]
    out = hypothesis.chi_square_test(spark.createDataFrame(rows, ["label", "v"]), "v", "label").collect()
    assert [r["degreesOfFreedom"] for r in out] == [1, 1, 2]
    assert [round(r["statistic"], 6) for r in out] == [3.0, 0.75, 3.0]
