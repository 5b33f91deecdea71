"""Filters, joins, aggregates and orderings on hand-made rows."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggregates, columns, cooccurrence, filters, joins, ordering, request


@pytest.fixture
def people(spark):
    rows = [(1, "a", 10.0), (2, "b", None), (3, None, 30.0), (4, "a", -5.0), (5, "c", 0.0)]
    return spark.createDataFrame(rows, "id int, name string, amount double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_request_steps_run_in_order(people):
    out = request.apply_request(
        people, filter="id > 1", select="name,amount", distinct=True, order_by="amount desc", limit=2
    )
    assert [r["amount"] for r in out.collect()] == [30.0, 0.0]
    assert request.apply_request(people, filter="id > 3", count=True).first()["count"] == 2


def test_request_without_arguments_changes_nothing(people):
    assert ids(request.apply_request(people)) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("spec", ["id up", "id desc please", "", "id,,name"])
def test_bad_order_is_refused(people, spec):
    with pytest.raises(ValueError):
        request.order_by_spec(people, spec)


def test_not_null_filter(people):
    assert ids(filters.filter_not_null(people, ["name", "amount"])) == [1, 4, 5]
    assert ids(filters.filter_not_null(people, [])) == [1, 2, 3, 4, 5]


def test_not_equal_filter_reads_null_as_not_null(people):
    assert ids(filters.filter_not_equal(people, "name", "null")) == [1, 2, 4, 5]
    assert ids(filters.filter_not_equal(people, "name", "a")) == [2, 5]


def test_optional_value(people):
    assert ids(filters.filter_optional_value(people, "name", None)) == [3]
    assert ids(filters.filter_optional_value(people, "name", "a")) == [1, 4]


def test_key_filter_forms_agree(spark, people):
    table = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "name string")
    assert ids(filters.filter_keys(people, table, "name")) == [1, 4]
    assert ids(filters.filter_keys(people, ["a", "z"], "name")) == [1, 4]
    assert ids(filters.filter_keys(people, [], "name")) == []
    long_list = ["a", *[f"z{i}" for i in range(filters.MAX_LITERAL_KEYS)]]
    assert ids(filters.filter_keys(people, long_list, "name")) == [1, 4]


def test_pair_key_filter(spark, people):
    pairs = [(1, "a"), (2, "x"), (5, "c")]
    assert ids(filters.filter_keys(people, pairs, ["id", "name"])) == [1, 5]
    table = spark.createDataFrame(pairs, "id int, name string")
    assert ids(filters.filter_keys(people, table, ["id", "name"])) == [1, 5]
    assert ids(filters.filter_keys(people, [], ["id", "name"])) == []


def test_constant_column_moves_last(people):
    out = columns.replace_with_constant(people, "name", 7)
    assert out.columns == ["id", "amount", "name"]
    assert {r["name"] for r in out.collect()} == {7}


def test_names_are_cleaned():
    assert columns.clean_name(" AGED 25+ WITHOUT ") == "AGED_25__WITHOUT"


def test_model_columns_lists():
    lists = columns.model_columns(["a", "b", "c", "d"], ["b", "x"], ["c", "b", "y"])
    assert lists == {
        "targets": ["b"],
        "features": ["c"],
        "targets_left": ["a", "c", "d"],
        "features_left": ["a", "b", "d"],
    }


def test_self_join_counts_on_the_small_example(spark):
    df = spark.createDataFrame([(1, "1"), (2, "2"), (3, "3")], "num int, str string")
    counts = joins.self_join_counts(df, "str", "num > 0", "num > 1")
    assert [tuple(r) for r in counts.filter("CAST(str AS INT) > 2").collect()] == [("3", 1)]


def test_self_join_counts_multiply_and_skip_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, None), (5, "b")], "num int, str string")
    counts = joins.self_join_counts(df, "str", "num > 1", "num < 3")
    assert [tuple(r) for r in counts.collect()] == [("a", 4)]


def test_pair_join_keeps_common_keys(spark, rows):
    left = spark.createDataFrame([("1", "Spark"), ("2", "Hadoop"), ("3", "Scala"), ("4", "Java")], "k string, v string")
    right = spark.createDataFrame([("1", "30K"), ("2", "15K"), ("3", "25K"), ("5", "10K")], "k string, pay string")
    assert [r[0] for r in rows(joins.join_pairs(left, right, "k"))] == ["1", "2", "3"]


def test_null_safe_join_matches_nulls(spark, rows):
    left = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "a int, v string")
    right = spark.createDataFrame([(None, 5), (2, 6)], "b int, w int")
    assert rows(joins.join_null_safe(left, right, [("a", "b")])) == [(None, "y", None, 5), (None, "z", None, 5)]
    none = joins.join_null_safe(left, right, [("a", "b")], F.col("v") > F.lit("y"))
    assert rows(none) == [(None, "z", None, 5)]


def test_unmatched_rows_keep_null_keys(spark, rows):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (None,)], "k int")
    assert rows(joins.join_unmatched(left, right, ["k"])) == [(2,), (None,)]


def test_pair_counts_equal_enumeration(spark):
    rng = random.Random(3)
    data = [(rng.randrange(6), rng.choice("abc")) for _ in range(60)]
    expected = {}
    for group in {g for g, _ in data}:
        pairs = list(itertools.combinations([i for g, i in data if g == group], 2))
        same = sum(a == b for a, b in pairs)
        expected[group] = (len(pairs), same, len(pairs) - same)
    out = joins.pair_counts(spark.createDataFrame(data, "g int, i string"), "g", "i")
    assert {r["g"]: tuple(r)[1:] for r in out.collect()} == expected


def test_typed_aggregates(spark, rows):
    df = spark.createDataFrame(
        [("x", 3, 30, "p", 1.0), ("x", 1, 10, None, 2.0), ("y", 5, 50, "q", None)],
        "g string, small int, big long, text string, real double",
    )
    assert rows(aggregates.aggregate_by_type(df, ["g"])) == [("x", 1, 30, 1, 2), ("y", 5, 50, 1, 0)]


def test_rate_table_skips_null_categories_and_counts_them_in_totals(spark):
    data = [("a", True), ("a", False), ("b", False), (None, True), ("c", True), ("c", None)]
    out = aggregates.rate_table(spark.createDataFrame(data, "k string, hit boolean"), "k", "hit").collect()
    assert [tuple(r) for r in out] == [
        ("a", 0.5, 1, 2, 1 / 3, 0.5, 2 / 6),
        ("c", 0.5, 1, 2, 1 / 3, 0.5, 2 / 6),
    ]


def test_collect_group_chunks_hold_everything(spark):
    data = [("hot", i % 7) for i in range(50)] + [("cold", 1), (None, 2), (None, 1)]
    out = aggregates.collect_group(spark.createDataFrame(data, "k string, v int"), "k", "v", chunk_size=8)
    got = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r["chunk"]):
        assert len(r["values"]) <= 8
        got[r["k"]] += r["values"]
    expected = defaultdict(list)
    for k, v in data:
        expected[k].append(v)
    assert {k: sorted(v) for k, v in expected.items()} == dict(got)


def test_equal_values_of_one_key_are_split(spark):
    df = spark.range(0, 1000, 1, 4).selectExpr("'hot' AS k", "1 AS v")
    out = aggregates.collect_group(df, "k", "v", chunk_size=64).collect()
    assert sorted(r["chunk"] for r in out) == list(range(16))
    assert sum(len(r["values"]) for r in out) == 1000
    assert max(len(r["values"]) for r in out) == 64


def test_plan_score_ignores_invalid_levels(spark):
    data = [("p", 0.4, 4), ("p", -1.0, 3), ("p", 0.2, 1), ("q", -1.0, 4)]
    df = spark.createDataFrame(data, "plan string, error double, weight int")
    out = {r["plan"]: r["score"] for r in aggregates.plan_score(df, "plan", "error", "weight").collect()}
    assert out == {"p": pytest.approx(0.6 / 5**1.5)}


def brute_force_pairs(data, k):
    baskets = defaultdict(list)
    for basket, item, q in data:
        baskets[basket].append((item, q))
    weights = Counter()
    for lines in baskets.values():
        for (a, qa), (b, qb) in itertools.combinations(lines, 2):
            weights[tuple(sorted((a, b)))] += qa * qb
    return sorted(((a, b, w) for (a, b), w in weights.items()), key=lambda r: (-r[2], r[0], r[1]))[:k]


@pytest.mark.parametrize("block, small", [(4096, 256), (4096, 0), (3, 0)])
def test_cooccurrence_equals_brute_force(spark, monkeypatch, block, small):
    monkeypatch.setattr(cooccurrence, "BLOCK_ITEMS", block)
    monkeypatch.setattr(cooccurrence, "SMALL_CATALOGUE", small)
    rng = random.Random(11)
    items = [f"i{n:02d}" for n in range(40)]
    popularity = [1 / (n + 1) for n in range(40)]
    # Basket 0 holds a third of all rows.
    data = [
        (0 if rng.random() < 0.33 else rng.randrange(1, 60), rng.choices(items, popularity)[0], float(rng.randint(1, 9)))
        for _ in range(400)
    ]
    df = spark.createDataFrame(data, "b int, i string, q double")
    out = cooccurrence.cooccurrence_topk(df, "b", "i", "q", 7)
    assert [tuple(r) for r in out.collect()] == brute_force_pairs(data, 7)


def test_cooccurrence_of_nothing_is_empty(spark):
    df = spark.createDataFrame([], "b int, i string, q double")
    assert cooccurrence.cooccurrence_topk(df, "b", "i", "q").collect() == []


def test_numbering_spans_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("x"))
    out = ordering.numbered(df, ["x"], name="n", start=0)
    assert all(r["x"] == r["n"] for r in out.collect())


def test_running_total_spans_partitions(spark):
    df = spark.range(1, 501, 1, 5).select("id", (F.col("id") % 3).alias("w"))
    out = ordering.running_total(df, ["id"], "w", "upto")
    total, expected = 0, {}
    for i in range(1, 501):
        total += i % 3
        expected[i] = total
    assert {r["id"]: r["upto"] for r in out.collect()} == expected


def test_sort_all_columns(spark):
    df = spark.createDataFrame([(2, "a"), (1, "b"), (1, "a")], "x int, y string")
    assert [tuple(r) for r in ordering.sort_all_columns(df).collect()] == [(1, "a"), (1, "b"), (2, "a")]
