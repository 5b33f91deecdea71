"""Streams of several batches, replays and the batch-wise learners."""

from __future__ import annotations

import datetime as dt
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.storage import scratch_path
from tablewright.streaming import learners, metrics, runner


def files_of(spark, frames):
    """A folder with one file per frame, in order of time."""
    folder = scratch_path(spark, "input")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)
    return runner.parquet_stream(spark, folder, frames[0].schema, files_per_batch=1)


def test_word_counts_per_batch_and_overall(spark):
    frames = [spark.createDataFrame([(t,)], "text string") for t in ["a b a", "b c"]]
    counts = metrics.batch_counts(metrics.words_of(files_of(spark, frames), "text"), "word")
    assert counts.select("batch_id").distinct().count() == 2
    total = {r["word"]: r["n"] for r in metrics.running_counts(counts, "word").collect()}
    assert total == {"a": 2, "b": 2, "c": 1}


def test_text_files_as_a_stream(spark, tmp_path):
    (tmp_path / "one.txt").write_text("x\ny\n")
    lines = runner.text_stream(spark, str(tmp_path))
    assert sorted(r["value"] for r in runner.run_to_table(lines, "lines").collect()) == ["x", "y"]


@pytest.fixture
def clicks(spark):
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(seconds=s), url, user, bad) for s, url, user, bad in [
        (1, "/a", 1, False), (3, "/a", 2, True), (5, "/b", 1, False), (9, "/a", 1, False), (40, "/z", 9, False),
    ]]
    return spark.createDataFrame(data, "ts timestamp, url string, user int, bad boolean")


def in_window(out, start_second):
    start = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=start_second)
    return [r for r in out.collect() if r["window_start"] == start]


def test_sliding_windows_close_behind_the_watermark(spark, clicks):
    counts = metrics.sliding_counts(files_of(spark, [clicks]), "ts", "url", "10 seconds", "2 seconds", "5 seconds")
    out = runner.run_to_table(counts, "sliding")
    assert {r["url"]: r["n"] for r in in_window(out, 0)} == {"/a": 3, "/b": 1}
    assert {r["url"]: r["n"] for r in in_window(out, 4)} == {"/a": 1, "/b": 1}
    assert all(r["url"] != "/z" for r in out.collect())


def test_error_rates_are_flagged(spark, clicks):
    rates = metrics.error_rates(files_of(spark, [clicks]), "ts", "url", F.col("bad"), "10 seconds", "2 seconds", "5 seconds")
    out = {r["url"]: (r["rate"], r["flagged"]) for r in in_window(runner.run_to_table(rates, "rates"), 0)}
    assert out == {"/a": (pytest.approx(1 / 3), True), "/b": (0.0, False)}


def test_active_users_are_distinct(spark, clicks):
    users = metrics.active_users(files_of(spark, [clicks]), "ts", "user", "10 seconds", "2 seconds", "5 seconds")
    assert [r["users"] for r in in_window(runner.run_to_table(users, "users"), 0)] == [2]


def test_blacklist_and_known_users(spark):
    words = spark.createDataFrame([("fail",), ("good",), ("sad",), ("good",), (None,)], "word string")
    listed = spark.createDataFrame([("fail",), ("sad",)], "word string")
    kept = runner.run_to_table(metrics.drop_listed(files_of(spark, [words]), listed, "word"), "kept")
    assert sorted(str(r["word"]) for r in kept.collect()) == ["None", "good", "good"]
    known = spark.createDataFrame([("good", "Ada")], "word string, name string")
    seen = runner.run_to_table(metrics.join_known(files_of(spark, [words]), known, "word"), "seen")
    assert [r["name"] for r in seen.collect()] == ["Ada", "Ada"]


def test_a_restart_reads_only_new_files(spark):
    folder, checkpoint = scratch_path(spark, "input"), scratch_path(spark, "checkpoint")
    seen = []
    for numbers in ([1, 2], [3]):
        spark.createDataFrame([(n,) for n in numbers], "n int").coalesce(1).write.mode("append").parquet(folder)
        stream = runner.parquet_stream(spark, folder, spark.read.parquet(folder).schema)
        runner.run_batches(stream, lambda b, i: seen.append(sorted(r["n"] for r in b.collect())), "x", checkpoint)
    assert seen == [[1, 2], [3]]


def test_a_restarted_table_goes_on_where_it_stopped(spark):
    folder, checkpoint, target = (scratch_path(spark, n) for n in ("input", "checkpoint", "target"))
    for numbers, want in (([1, 2], [1, 2]), ([3], [1, 2, 3]), ([], [1, 2, 3])):
        spark.createDataFrame([(n,) for n in numbers], "n int").coalesce(1).write.mode("append").parquet(folder)
        stream = runner.parquet_stream(spark, folder, spark.read.parquet(folder).schema)
        assert sorted(r["n"] for r in runner.run_to_table(stream, "x", checkpoint, target).collect()) == want
    with pytest.raises(ValueError):
        runner.run_to_table(stream, "x", checkpoint)


def test_kmeans_update_by_hand(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([2.0, 0.0],), ([10.0, 10.0],)], "v array<double>")
    model = learners.StreamingKMeans([[1.0, 1.0], [9.0, 9.0]], weight=2.0, decay=0.5)
    model.update(df, "v")
    # weight 2 decays to 1: ((1,1) + (2,0)) / 3 and ((9,9) + (10,10)) / 2
    assert np.allclose(model.centres, [[1.0, 1 / 3], [9.5, 9.5]])
    assert np.allclose(model.weights, [3.0, 2.0])


def test_kmeans_learns_over_batches_and_predicts(spark):
    rng = np.random.default_rng(0)
    frames = []
    for _ in range(3):
        points = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2))])
        frames.append(spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>"))
    model = learners.StreamingKMeans([[1.0, 1.0], [4.0, 4.0]])
    states = model.train_on(files_of(spark, frames), "v")
    assert states.select("batch_id").distinct().count() == 3
    assert np.allclose(model.centres, [[0, 0], [5, 5]], atol=0.1)
    predicted = runner.run_to_table(model.predict_on(files_of(spark, frames[:1]), "v").select("cluster"), "p")
    assert sorted(r["count"] for r in predicted.groupBy("cluster").count().collect()) == [20, 20]


def test_a_stored_batch_is_not_applied_twice(spark):
    df = spark.createDataFrame([([0.0],), ([4.0],)], "v array<double>")
    model = learners.StreamingKMeans([[1.0]], weight=1.0)
    store = learners.StateStore(spark, model.SCHEMA)
    store.save(0, [(0, 7.0, [3.0])])
    assert [(r["weight"], r["centre"]) for r in store.load(0)] == [(7.0, [3.0])]
    assert store.load(1) is None
    model.restore(store.load(0))
    assert (model.weights[0], model.centres[0][0]) == (7.0, 3.0)
    assert [r["weight"] for r in store.latest()] == [7.0]
    assert df.count() == 2


def numbers(i):
    """A batch of labelled points, with nulls, that differs from batch to batch."""
    rng = np.random.default_rng(i)
    rows = [([float(a), float(b)], 1.0, float(a), float(a + b > i / 3), bool(a > 0), float(b) + i / 10) for a, b in rng.normal(0, 1, (40, 2))]
    return [*rows, (None, 1.0, None, 1.0, None, 2.0), ([0.5, 0.5], 1.0, 0.5, None, True, None)]


POINTS = "v array<double>, one double, x double, label double, side boolean, value double"
LEARNERS = {
    "kmeans": (lambda: learners.StreamingKMeans([[0.5, 0.0], [-0.5, 0.1]], weight=1.0, decay=0.9), lambda m, s, f: m.train_on(s, "v", f), lambda m: [*m.weights, *m.centres.ravel()]),
    "linear": (lambda: learners.StreamingLinearRegression(["one", "x"], step=0.5, iterations=20), lambda m, s, f: m.train_on(s, f), lambda m: [*m.weights]),
    "logistic": (lambda: learners.StreamingLogisticRegression(["one", "x"], step=1.0, iterations=3), lambda m, s, f: m.train_on(s, f), lambda m: [*m.weights]),
    "welch": (lambda: learners.StreamingWelchTest(level=0.0), lambda m, s, f: m.run(s, "side", "value", f), lambda m: [m.t, m.df, m.p, m.batches]),
}


@pytest.mark.parametrize("name", sorted(LEARNERS))
def test_a_learner_goes_on_in_a_new_session(spark, name):
    make, train, numbers_of = LEARNERS[name]
    whole, parts, kept = scratch_path(spark, "whole"), scratch_path(spark, "parts"), scratch_path(spark, "kept")
    unbroken = make()
    for i in range(4):
        spark.createDataFrame(numbers(i), POINTS).coalesce(1).write.mode("append").parquet(whole)
    schema = spark.read.parquet(whole).schema
    # Files are read in the order they were written, one a batch.
    train(unbroken, runner.parquet_stream(spark, whole, schema, files_per_batch=1), None)
    for run, batches in enumerate([range(2), range(2, 4), range(0)]):
        for i in batches:
            spark.createDataFrame(numbers(i), POINTS).coalesce(1).write.mode("append").parquet(parts)
        session = spark.newSession()
        again = make()
        train(again, runner.parquet_stream(session, parts, schema, files_per_batch=1), kept)
        if run:
            assert numbers_of(again) == pytest.approx(numbers_of(unbroken), rel=1e-12)
        else:
            assert numbers_of(again) != pytest.approx(numbers_of(unbroken), rel=1e-6)


def test_a_version_left_half_written_is_not_taken_up(spark):
    store = learners.StateStore(spark, "n int")
    assert store.latest() is None
    store.save(0, [(1,)])
    store.save(10, [(2,)])
    filesystem, path = learners.hadoop_path(spark, f"{store.folder}/batch_id=11")
    filesystem.mkdirs(path)
    assert store.latest()[0]["n"] == 2


def test_many_centres_as_brute_force(spark):
    rng = np.random.default_rng(1)
    points, centres = rng.integers(0, 6, (700, 4)).astype(float), rng.integers(0, 6, (500, 4)).astype(float)
    slow = [min(range(500), key=lambda c: (((centres[c] - p) ** 2).sum(), c)) for p in points]
    assert learners.nearest(points, centres).tolist() == slow
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(700, None)], "i int, v array<double>")
    model = learners.StreamingKMeans(centres)
    got = {r["i"]: r["cluster"] for r in model.predict_on(df, "v").collect()}
    assert [got[i] for i in range(700)] == slow and got[700] is None
    plans = [learners.StreamingKMeans(centres[:k]).predict_on(df, "v")._jdf.queryExecution().toString() for k in (2, 500)]
    assert abs(len(plans[0]) - len(plans[1])) < 50
    model.update(df, "v")
    for c in set(slow):
        assert model.centres[c] == pytest.approx(np.mean([p for p, s in zip(points, slow) if s == c], axis=0))


def test_wide_gradients_have_small_plans(spark):
    """One vector is added up, not a column for each pair of features."""
    rng = np.random.default_rng(2)
    x, names = rng.normal(0, 1, (50, 30)), [f"f{i}" for i in range(30)]
    y = x @ np.arange(30) / 30
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{n} double" for n in [*names, "label"]))
    model = learners.StreamingLinearRegression(names, step=0.1, iterations=3)
    model.update(df)
    w = np.zeros(30)
    for i in range(1, 4):
        w = w - 0.1 / np.sqrt(i) * (x.T @ (x @ w - y)) / 50
    assert model.weights == pytest.approx(w)
    logistic = learners.StreamingLogisticRegression(names, step=0.1, iterations=2)
    logistic.update(df.withColumn("label", (F.col("label") > 0).cast("double")))
    w = np.zeros(30)
    for i in range(1, 3):
        w = w - 0.1 / np.sqrt(i) * (x.T @ (1 / (1 + np.exp(-x @ w)) - (y > 0))) / 50
    assert logistic.weights == pytest.approx(w)
    model.update(df.limit(0))


def test_windows_close_at_the_end_of_input(spark, clicks):
    from collections import Counter

    seen = Counter()
    late = clicks.limit(1)
    # Spark drops rows behind the watermark of the batch before the last.
    source = files_of(spark, [clicks, clicks.where("url = '/z'"), late])

    def counts(stream):
        return metrics.sliding_counts(stream, "ts", "url", "10 seconds", "2 seconds", "5 seconds")

    out = runner.run_to_end(source, "ts", counts, "end", seen=seen)
    assert {r["url"]: r["n"] for r in in_window(out, 0)} == {"/a": 3, "/b": 1}  # the late click is not in it
    assert {r["url"]: r["n"] for r in in_window(out, 40)} == {"/z": 2}
    assert out.where("url = '/z'").count() == 5 and out.where("url is null").count() == 0
    assert seen["rows"] == 8 and seen["late_rows"] >= 1
    users = runner.run_to_end(files_of(spark, [clicks]), "ts", lambda s: metrics.active_users(s, "ts", "user", "10 seconds", "2 seconds", "5 seconds"), "end")
    assert [r["users"] for r in in_window(users, 0)] == [2] and [r["users"] for r in in_window(users, 40)] == [1]
    assert runner.run_to_end(files_of(spark, [clicks.limit(0)]), "ts", counts, "end").count() == 0
    with pytest.raises(ValueError):
        runner.run_to_end(source, "ts", counts, "end", target="x")


def test_linear_regression_reaches_least_squares(spark):
    frames = [
        spark.createDataFrame([(1.0, x / 10, 2.0 + 3.0 * x / 10) for x in range(i, 30, 3)], "one double, x double, label double")
        for i in range(3)
    ]
    model = learners.StreamingLinearRegression(["one", "x"], step=0.2, iterations=2000)
    states = model.train_on(files_of(spark, frames))
    assert states.count() == 6
    assert np.allclose(model.weights, [2.0, 3.0], atol=0.05)
    out = model.predict_on(frames[0]).select("label", "prediction").collect()
    assert all(r["label"] == pytest.approx(r["prediction"], abs=0.2) for r in out)


def test_logistic_regression_separates(spark):
    frames = [
        spark.createDataFrame([(1.0, float(x), float(x > 0)) for x in range(-5 + i, 6, 2) if x], "one double, x double, label double")
        for i in range(2)
    ]
    model = learners.StreamingLogisticRegression(["one", "x"], step=1.0, iterations=10)
    model.train_on(files_of(spark, frames))
    out = model.predict_on(frames[0]).collect()
    assert all(r["label"] == r["prediction"] for r in out)


def welch(a, b):
    ea, eb = statistics.variance(a) / len(a), statistics.variance(b) / len(b)
    return (statistics.mean(a) - statistics.mean(b)) / (ea + eb) ** 0.5


def test_welch_merges_batches(spark):
    parts = [([1.0, 2.0], [1.5, 2.5, 1.0]), ([3.0, 1.0, 2.0], [2.0]), ([1.7], [2.2, 1.4])]
    frames = [
        spark.createDataFrame([(True, v) for v in a] + [(False, v) for v in b], "label boolean, value double")
        for a, b in parts
    ]
    out = learners.StreamingWelchTest().run(files_of(spark, frames), "label", "value").first()
    a, b = sum((p[0] for p in parts), []), sum((p[1] for p in parts), [])
    assert out["t"] == pytest.approx(welch(a, b))
    assert out["batches"] == 3 and out["p"] > 0.05


def test_welch_stops_when_significant(spark):
    clear = spark.createDataFrame([(True, 1.0 + i / 100) for i in range(9)] + [(False, 5.0 + i / 100) for i in range(9)], "label boolean, value double")
    out = learners.StreamingWelchTest().run(files_of(spark, [clear] * 4), "label", "value").first()
    assert out["p"] < 0.05 and out["batches"] == 1
