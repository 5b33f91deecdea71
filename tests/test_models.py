"""Learners: better than guessing, repeatable, and exact where a formula exists."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.analysis import evaluation, sampling
from tablewright.functions import features as ft
from tablewright.learning import classification as cl, clustering, regression as rg, spectral, topics
from tablewright.operators import patterns

BASKETS = ["r z h k p", "z y x w v u t s", "s x o n r", "x z y m t s q e", "z", "x z y r q t p"]


@pytest.fixture(scope="module")
def flags(spark):
    """Two classes split by x + y, with some noise."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        x, y = rng.random(), rng.random()
        rows.append((i, float(x + y + rng.gauss(0, 0.05) > 1), x, y))
    df = spark.createDataFrame(rows, "id int, label double, x double, y double")
    return ft.assemble(df, ["x", "y"]).cache()


@pytest.mark.parametrize(
    "learner",
    [
        lambda: cl.decision_tree(),
        lambda: cl.random_forest(10),
        lambda: cl.boosted_trees(5, 3),
        lambda: cl.linear_svm(50),
        lambda: cl.perceptron([2, 4, 2], 60),
    ],
    ids=["tree", "forest", "boosted", "svm", "perceptron"],
)
def test_classifiers_beat_guessing(flags, learner):
    train, test = sampling.hash_split(flags, "id", 0.7)
    scored = learner().fit(train).transform(test)
    assert evaluation.classification_scores(scored).first()["accuracy"] > 0.85


def test_logistic_settings_reach_the_model(flags):
    model = cl.logistic(flags, max_iter=30, reg=0.1, threshold=0.55, probability="chance")
    scored = model.transform(flags)
    assert "chance" in scored.columns
    chance = scored.select(cl.positive_probability(scored, "chance").alias("p"), "prediction").collect()
    assert all((r["p"] > 0.55) == (r["prediction"] == 1.0) for r in chance)


def test_sparse_svm_ranks_and_drops_useless_slots(spark, flags):
    noisy = flags.select("label", "x", "y", (F.rand(3) - 0.5).alias("noise"))
    centred = noisy.withColumns({"x": F.col("x") - 0.5, "y": F.col("y") - 0.5})
    vectors = ft.assemble(centred, ["x", "y", "noise"])
    weights = cl.sparse_svm(vectors, max_iter=100, reg=0.05)
    assert weights[0] > 0.1 and weights[1] > 0.1 and abs(weights[2]) < 0.1
    scored = cl.linear_scores(vectors, weights, 0.0)
    assert evaluation.area_under_roc(scored, "label", "score").first()["auc"] > 0.9


def test_cross_validation_prefers_signal(spark):
    rows = [(i, "good fine great" if i % 2 else "bad poor awful", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, label double")
    scores, model = cl.cross_validate_text(df, buckets=(100,), regs=(0.1, 0.01), seed=1)
    assert scores.count() == 2
    assert scores.agg(F.min("auc")).first()[0] > 0.95
    unseen = spark.createDataFrame([(1, "great"), (2, "awful")], "id int, text string")
    flagged = {r["id"]: r["flagged"] for r in cl.score_rows(model.bestModel, unseen).collect()}
    assert flagged == {1: False, 2: True}


def test_least_squares_is_exact(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1.0) for x in range(10)], "x double, label double")
    vectors = ft.assemble(df, ["x"])
    out = {r["term"]: r["coefficient"] for r in rg.coefficient_table(rg.least_squares(vectors), ["x"], vectors).collect()}
    assert out == {"x": pytest.approx(2.0), "intercept": pytest.approx(1.0)}


def test_lasso_drops_a_useless_slot(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(x := rng.random(), rng.random(), 3 * x) for _ in range(100)], "x double, n double, label double")
    model = rg.lasso(ft.assemble(df, ["x", "n"]), 0.1)
    assert model.coefficients[1] == 0.0 and model.coefficients[0] > 1


@pytest.mark.parametrize("learner", [rg.decision_tree, rg.random_forest, rg.boosted_trees], ids=["tree", "forest", "boosted"])
def test_regressors_beat_the_mean(spark, learner):
    df = spark.createDataFrame([(i, i % 20 / 20, float((i % 20 > 10) * 4)) for i in range(300)], "id int, x double, label double")
    train, test = sampling.hash_split(ft.assemble(df, ["x"]), "id", 0.7)
    rmse = evaluation.regression_errors(learner().fit(train).transform(test)).first()["rmse"]
    assert rmse < 0.5 * test.agg(F.stddev("label")).first()[0]


def test_survival_on_the_published_rows(spark):
    rows = [
        (1.218, 1.0, Vectors.dense(1.560, -0.605)),
        (2.949, 0.0, Vectors.dense(0.346, 2.158)),
        (3.627, 0.0, Vectors.dense(1.380, 0.231)),
        (0.273, 1.0, Vectors.dense(0.520, 1.151)),
        (4.199, 0.0, Vectors.dense(0.795, -0.226)),
    ]
    df = spark.createDataFrame(rows, ["label", "censor", "features"])
    out = rg.survival(df).transform(df).collect()
    assert all(r["quantiles"][0] < r["quantiles"][1] for r in out)


def test_isotonic_pools_violators(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (3.0, 2.0), (4.0, 5.0)], "x double, y double")
    table = {r["boundary"]: r["prediction"] for r in rg.isotonic_table(rg.isotonic(df, "x", "y")).collect()}
    assert table[1.0] == 1.0 and table[4.0] == 5.0
    assert table[2.0] == pytest.approx(7 / 3) and table[3.0] == pytest.approx(7 / 3)


def slow_isotonic(rows):
    """(low, high, mean) of the steps, pooled over all values at once."""
    sums = {}
    for x, y in rows:
        n, total = sums.get(x, (0, 0.0))
        sums[x] = (n + 1, total + y)
    steps = []
    for x in sorted(sums):
        steps.append([x, x, *sums[x]])
        while len(steps) > 1 and steps[-2][3] / steps[-2][2] >= steps[-1][3] / steps[-1][2]:
            _, high, n, total = steps.pop()
            steps[-1][1:] = [high, steps[-1][2] + n, steps[-1][3] + total]
    return [(low, high, total / n) for low, high, n, total in steps]


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "valley"])
def test_isotonic_in_stretches_is_isotonic_at_once(spark, kind):
    rng = random.Random(kind)
    of = {"noise": lambda x: x / 20 + rng.gauss(0, 3), "falling": lambda x: -x, "rising": lambda x: x, "valley": lambda x: abs(x - 50) + rng.random()}[kind]
    rows = [(float(x % 97), float(of(x % 97))) for x in range(150)]
    df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "x double, y double").repartition(3)
    want = slow_isotonic(rows)
    for at_once in (8, 1000):
        steps = rg.isotonic(df, "x", "y", at_once)
        got = [(r["low"], r["high"], r["prediction"]) for r in steps.orderBy("no").collect()]
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
    # Between and beyond the steps as the library does it.
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol="x", labelCol="y").fit(df.na.drop())
    asked = spark.createDataFrame([(v / 4,) for v in range(-8, 420, 3)], "x double")
    plain = {r["x"]: r["prediction"] for r in model.transform(asked).collect()}
    found = {r["x"]: r["prediction"] for r in rg.isotonic_predictions(steps, asked, "x").collect()}
    assert set(found) == set(plain)
    for x, p in plain.items():
        assert found[x] == pytest.approx(p, abs=1e-9)


def test_isotonic_of_nothing(spark):
    df = spark.createDataFrame([], "x double, y double")
    steps = rg.isotonic(df, "x", "y")
    asked = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert steps.count() == 0 and [r["prediction"] for r in rg.isotonic_predictions(steps, asked, "x").collect()] == [None, None]


def test_clusters_of_the_published_rows(spark):
    rows = [(Vectors.dense([v] * 3),) for v in (0.0, 0.1, 0.2, 9.0, 9.1, 9.2)]
    df = spark.createDataFrame(rows, ["features"])
    for model in (clustering.kmeans(df, 2), clustering.bisecting_kmeans(df, 2)):
        got = [r["prediction"] for r in model.transform(df).collect()]
        assert got[:3] == [got[0]] * 3 and got[3:] == [1 - got[0]] * 3
    assert clustering.kmeans(df, 2).summary.trainingCost == pytest.approx(0.12)
    assert sum(clustering.gaussian_mixture(df, 2).weights) == pytest.approx(1.0)


def test_singular_values_equal_numpy(spark):
    x = np.array([[0, 1, 0, 7, 0], [2, 0, 3, 4, 5], [4, 0, 0, 6, 7]], dtype=float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>").repartition(3)
    values, right = spectral.singular_values(df, "v", 5, 3)
    assert np.allclose(values, np.linalg.svd(x)[1])
    left = np.array([r["u"] for r in clustering.left_vectors(df, "v", values, right).orderBy("i").collect()])
    assert np.allclose(left * values @ right.T, x)
    nothing = spark.createDataFrame([(1, None), (2, [1.0] * 5)], "i int, v array<double>").coalesce(1)
    assert [r["u"] is None for r in clustering.left_vectors(nothing, "v", values, right).orderBy("i").collect()] == [True, False]


@pytest.mark.parametrize("rows, columns, k", [(2000, 500, 5), (40, 12, 12), (3, 60, 5)])
def test_leading_vectors_equal_numpy(spark, rows, columns, k):
    """A matrix product a step, whose widest array is columns by some k."""
    rng = np.random.default_rng(rows)
    x = rng.normal(0, 1, (rows, columns)) * np.linspace(3, 0.1, columns)
    calls = []

    def multiply(block):
        calls.append(block.shape[1])
        return x.T @ (x @ block)

    values, vectors = spectral.largest(multiply, columns, k)
    exact = np.linalg.svd(x)[1]
    assert np.allclose(np.sqrt(np.clip(values, 0, None))[: len(exact)], exact[:k], rtol=1e-6, atol=1e-4)
    assert max(calls) <= k + spectral.SPARE and len(calls) < spectral.STEPS
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-8)


def test_equal_and_zero_singular_values(spark):
    df = spark.createDataFrame([([2.0, 0.0, 0.0],), ([0.0, 2.0, 0.0],), (None,)], "v array<double>")
    values, right = spectral.singular_values(df, "v", 3, 3)
    assert np.allclose(values, [2, 2, 0]) and np.allclose(right.T @ right, np.eye(3))
    assert np.allclose(spectral.singular_values(df.limit(0), "v", 3, 2)[0], 0)


def test_principal_components_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 40)) * np.linspace(2, 0.1, 40) + 1000
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(300, None)], "i int, v array<double>").repartition(3)
    model = spectral.principal_components(df, "v", 4)
    spread, directions = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(model.explained, spread[::-1][:4] / spread.sum(), rtol=1e-6)
    got = {r["i"]: r["pca"] for r in model.transform(df, "v").collect()}
    assert np.allclose(np.abs([got[i] for i in range(300)]), np.abs(x @ directions[:, ::-1][:, :4]), rtol=1e-4, atol=1e-3)
    assert got[300] is None


def slow_topics(counts, k, steps, first):
    """The same inference in plain Python, a document at a time; counts: {doc: {term: n}}."""
    from math import exp

    def dg(x):
        return float(topics.digamma(np.array([x]))[0])

    weights = {t: list(first(t)) for doc in counts.values() for t in doc}
    for _ in range(steps):
        totals = [sum(w[j] for w in weights.values()) for j in range(k)]
        beta = {t: [exp(dg(w[j]) - dg(totals[j])) for j in range(k)] for t, w in weights.items()}
        new = {t: [1 / k] * k for t in weights}
        for doc in counts.values():
            gamma = [1 / k + sum(doc.values()) / k] * k
            for _ in range(topics.MIX_STEPS):
                theta = [exp(dg(g) - dg(sum(gamma))) for g in gamma]
                moved = [1 / k + sum(n * theta[j] * beta[t][j] / sum(theta[i] * beta[t][i] for i in range(k)) for t, n in doc.items()) for j in range(k)]
                change = sum(abs(a - b) for a, b in zip(gamma, moved)) / k
                gamma = moved
                if change < topics.MIX_CHANGE:
                    break
            theta = [exp(dg(g) - dg(sum(gamma))) for g in gamma]
            for t, n in doc.items():
                whole = sum(theta[i] * beta[t][i] for i in range(k))
                for j in range(k):
                    new[t][j] += n * theta[j] * beta[t][j] / whole
        weights = new
    return weights


def test_topics_equal_plain_python(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, [rng.choice("abcdefgh" if i % 2 else "ghijklmn") for _ in range(rng.randint(1, 30))]) for i in range(25)] + [(99, []), (None, ["a", None])]
    df = spark.createDataFrame(docs, "id int, words array<string>")
    counts = topics.term_counts(df, "id", "words")
    plain = {d: Counter(w for w in words if w) for d, words in docs if any(words)}
    monkeypatch.setattr(topics, "BLOCK_ROWS", 7)  # documents run over blocks
    model = topics.fit_topics(counts, 3, steps=4)
    names = sorted({t for c in plain.values() for t in c})
    first = {r["t"]: r["w"] for r in spark.createDataFrame([(t,) for t in names], "t string").select("t", topics.first_weights(F.col("t"), 3, 1).alias("w")).collect()}
    want = slow_topics(plain, 3, 4, first.__getitem__)
    got = {r["term"]: r["weights"] for r in model.terms.collect()}
    assert set(got) == set(want)
    for t in want:
        assert got[t] == pytest.approx(want[t], rel=1e-6)
    mixes = {r["doc"]: r["mix"] for r in model.documents(counts).collect()}
    assert set(mixes) == set(plain) and all(sum(m) == pytest.approx(1) for m in mixes.values())
    totals = [sum(w[j] for w in want.values()) for j in range(3)]
    likely = sum(n * np.log(sum(mixes[d][j] * want[t][j] / totals[j] for j in range(3))) for d, c in plain.items() for t, n in c.items())
    assert model.log_likelihood(counts).first()["log_likelihood"] == pytest.approx(likely, rel=1e-6)
    best = model.top_terms(2).collect()
    assert len(best) == 6
    for r in best:
        assert sorted(names, key=lambda t: (-want[t][r["topic"]], t))[r["place"]] == r["term"]


def test_topics_are_the_same_on_any_number_of_partitions(spark):
    df = spark.createDataFrame([(i, ["cat", "dog"] * (i % 3 + 1) if i % 2 else ["sun", "moon", "sky"]) for i in range(30)], "id int, words array<string>")
    found = []
    for parts in (1, 7):
        counts = topics.term_counts(df.repartition(parts), "id", "words", 2.0)
        found.append({r["term"]: r["weights"] for r in topics.fit_topics(counts, 2, steps=3).terms.collect()})
    assert set(found[0]) == {"cat", "dog", "sun", "moon", "sky"}
    for t, w in found[0].items():
        assert w == pytest.approx(found[1][t], rel=1e-9)


def test_topics_are_as_likely_as_the_library_s(spark):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    from tablewright.functions import text

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", text.title_tokens(F.col("text")).alias("words"))
    counts = topics.term_counts(docs, "doc_id", "words", 4.0).persist()
    ours = topics.fit_topics(counts, 5, steps=10).log_likelihood(counts).first()["log_perplexity"]
    counter = CountVectorizer(inputCol="words", outputCol="features", minDF=4.0).fit(docs)
    vectors = counter.transform(docs)
    model = LDA(k=5, maxIter=10, seed=1).fit(vectors)
    phi = model.topicsMatrix().toArray()
    phi = phi / phi.sum(0)
    total = tokens = 0.0
    for row in model.transform(vectors).select("features", "topicDistribution").collect():
        p = phi[row["features"].indices] @ row["topicDistribution"].toArray()
        if len(p):
            total += (row["features"].values * np.log(p)).sum()
            tokens += row["features"].values.sum()
    assert ours <= -total / tokens * 1.02


def test_topics_of_nothing(spark):
    counts = topics.term_counts(spark.createDataFrame([], "id int, words array<string>"), "id", "words")
    model = topics.fit_topics(counts, 2, steps=1)
    assert model.terms.count() == model.documents(counts).count() == model.top_terms(2).count() == 0


def test_recommender_drops_unknown_users(spark):
    rows = [(u, i, 1.0 + (u + i) % 3) for u in range(6) for i in range(5)]
    model = clustering.recommender(spark.createDataFrame(rows, "user int, item int, rating float"))
    asked = spark.createDataFrame([(1, 1), (99, 1)], "user int, item int")
    assert [r["user"] for r in model.transform(asked).collect()] == [1]


def basket_frame(spark):
    rows = [(n, item) for n, line in enumerate(BASKETS) for item in line.split()]
    return spark.createDataFrame(rows, "basket int, item string")


def brute_itemsets(least):
    counts = Counter()
    for line in BASKETS:
        items = sorted(set(line.split()))
        for size in range(1, len(items) + 1):
            counts.update(itertools.combinations(items, size))
    return {k: n for k, n in counts.items() if n >= least}


def test_itemsets_equal_enumeration(spark):
    items = patterns.baskets(basket_frame(spark), "basket", "item", 0.5)
    assert items.count() == len(BASKETS)
    found = patterns.frequent_itemsets(items, 0.5).freqItemsets.collect()
    assert {tuple(sorted(r["items"])): r["freq"] for r in found} == brute_itemsets(3)


def test_there_are_54_itemsets_at_a_fifth(spark):
    items = patterns.baskets(basket_frame(spark), "basket", "item", 0.2)
    assert patterns.frequent_itemsets(items, 0.2).freqItemsets.count() == 54 == len(brute_itemsets(2))


def test_rules_of_the_published_counts(spark):
    sets = spark.createDataFrame([(["a"], 15), (["b"], 35), (["a", "b"], 12)], "items array<string>, freq long")
    out = patterns.association_rules(sets, 0.8).collect()
    assert [(r["antecedent"], r["consequent"], r["confidence"]) for r in out] == [(["a"], "b", 0.8)]


def test_rules_agree_with_the_miner(spark):
    items = patterns.baskets(basket_frame(spark), "basket", "item", 0.5)
    model = patterns.frequent_itemsets(items, 0.5, 0.8)
    mine = patterns.association_rules(model.freqItemsets, 0.8)
    key = lambda r: (tuple(sorted(r["antecedent"])), r["consequent"])
    theirs = {
        (tuple(sorted(r["antecedent"])), r["consequent"][0]): r["confidence"] for r in model.associationRules.collect()
    }
    assert {key(r): r["confidence"] for r in mine.collect()} == pytest.approx(theirs)


def test_sequences_of_the_published_rows(spark):
    rows = [([[1, 2], [3]],), ([[1], [3, 2], [1, 2]],), ([[1, 2], [5]],), ([[6]],)]
    df = spark.createDataFrame(rows, "sequence array<array<int>>")
    out = {str([sorted(s) for s in r["sequence"]]): r["freq"] for r in patterns.frequent_sequences(df, 0.5, 5).collect()}
    assert out == {"[[1]]": 3, "[[2]]": 3, "[[3]]": 2, "[[1, 2]]": 3, "[[1], [3]]": 2}


def test_long_sequences_are_mined_from_rows(spark):
    """A key of 3,000 rows, ties, repeats, a null key and a null item."""
    rows = [(1, i, "abc"[i % 3]) for i in range(3000)] + [(2, 0, "b"), (2, 0, "a"), (None, 1, "a"), (None, 2, "a"), (3, 0, None)]
    df = spark.createDataFrame(rows, "k int, t int, item string")
    out = {"".join(r["sequence"]): r["freq"] for r in patterns.mine_sequences(df, "k", ["t"], "item", 0.5, 3).collect()}
    assert out == {"a": 3, "b": 2, "aa": 2, "ab": 2}
