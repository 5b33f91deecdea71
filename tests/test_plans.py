"""Actions, transforms, plans and the search."""

from __future__ import annotations

import math

import pytest
from pyspark.ml.functions import array_to_vector

from tablewright.plans import fitness as fit
from tablewright.plans import search, transforms
from tablewright.plans.actions import Actions, apply_filters, load_actions, parse_actions, plan_matrix
from tablewright.plans.apply import apply_plan, chosen_columns, effective_plan, make_setting, plan_bits

# The published action table and plan matrix.
ACTIONS = [
    ("rank", "filter", "null"),
    ("city state", "related_to", "other related"),
    ("college", "related_to", "any"),
    ("superzip", "related_to", "any"),
    ("superzip", "related_to", "different avg"),
    ("all", "related_to", "meaningful"),
    ("superzip", "related_to", "zipcode"),
]
MATRIX = [
    ("trans1", "state adultpop households centile"),
    ("trans2", "superzip rank state income centile"),
]


@pytest.fixture
def table(spark):
    rows = [(1, "a", 1.0, 5.0), (2, None, 400.0, None), (None, "c", -3.0, 6.0), (4, "d", 0.0, 7.0)]
    return spark.createDataFrame(rows, "n int, s string, wide double, narrow double")


def test_actions_are_classified(spark):
    df = spark.createDataFrame(ACTIONS, "target string, action string, object string")
    assert [r["level"] for r in parse_actions(df).collect()] == [1, 3, 3, 3, 3, 3, 3]
    loaded = load_actions(df)
    assert loaded.filters == [("rank", "filter", "null")]
    assert loaded.targets == ["city", "state", "college", "superzip"]
    assert loaded.objects == ["other", "related", "different", "avg", "meaningful", "zipcode"]


def test_null_filter_keeps_rows_with_a_value(table):
    assert apply_filters(table, [("s", "filter", "null")]).count() == 3
    assert apply_filters(table, [("s", "filter", "a"), ("n", "keep", "1")]).count() == 2


def test_plan_matrix(spark):
    rows = [(t, c) for t, columns in MATRIX for c in columns.split()]
    names = ["zipcode", "superzip", "rank", "city", "state", "adultpop", "households", "college", "income", "centile"]
    out = plan_matrix(spark.createDataFrame(rows, "transform string, column string"), names).orderBy("transform").collect()
    assert tuple(out[0])[1:] == (0, 0, 0, 0, 1, 1, 1, 0, 0, 1)
    assert tuple(out[1])[1:] == (0, 1, 1, 0, 1, 0, 0, 0, 1, 1)


def test_registry_is_in_name_order():
    assert transforms.transform_names() == ["trans1", "trans2", "trans3", "trans4", "trans5"]


def test_log_goes_by_name_and_variance(table):
    setting = make_setting(table)
    out = transforms.conditional_log(table, ["wide", "narrow", "n"], setting.variances).collect()
    assert [r["wide"] for r in out] == [0.0, pytest.approx(math.log(400)), None, None]
    assert [r["narrow"] for r in out] == [5.0, None, 6.0, 7.0]
    unchosen = transforms.conditional_log(table, ["narrow"], setting.variances)
    assert [r["wide"] for r in unchosen.collect()] == [1.0, 400.0, -3.0, 0.0]


def test_nulls_get_type_defaults(spark):
    df = spark.createDataFrame([(None,) * 6], "i int, l long, d double, s string, t date, b boolean")
    row = transforms.fill_nulls_by_type(df, df.columns).first()
    assert (row["i"], row["l"], row["d"], row["s"], str(row["t"]), row["b"]) == (0, 0, 0.0, "", "1970-01-01", None)
    assert transforms.fill_nulls_by_type(df, ["s"]).first()["i"] is None


def test_plan_bits_round_trip():
    chosen = {"trans1": ["a"], "trans3": ["a", "c"], "trans5": ["b"]}
    bits = plan_bits(chosen, ["a", "b", "c"])
    assert bits == (1, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0, 1, 0)
    back = chosen_columns(bits, ["a", "b", "c"])
    assert {k: v for k, v in back.items() if v} == chosen
    with pytest.raises(ValueError):
        chosen_columns(bits, ["a", "b"])


def test_applied_plan(table):
    bits = plan_bits({"trans1": ["n"], "trans2": ["narrow"], "trans3": ["wide"], "trans4": ["s"]}, table.columns)
    out = apply_plan(table, bits, make_setting(table, constant=9)).collect()
    assert [tuple(r) for r in out] == [(1, "a", 0.0, 9), (2, "", pytest.approx(math.log(400)), 9), (4, "d", None, 9)]


def test_empty_plan_sorts_only(table):
    out = apply_plan(table, [0] * 20, make_setting(table))
    assert out.columns == table.columns and out.count() == 4


def test_plans_of_equal_effect_are_one(table):
    setting = make_setting(table, sort=False)
    plain = plan_bits({"trans2": ["n"]}, table.columns)
    noisy = plan_bits({"trans2": ["n", "s"], "trans3": ["narrow", "s"], "trans4": ["n"], "trans5": ["s"]}, table.columns)
    assert effective_plan(noisy, table, setting) == plain
    assert [tuple(r) for r in apply_plan(table, noisy, setting).collect()] == [
        tuple(r) for r in apply_plan(table, plain, setting).collect()
    ]


def test_bits_without_nulls_to_act_on_are_dropped(table):
    setting = make_setting(table, sort=False)
    assert setting.nullable == {"n", "s", "narrow"}
    bits = plan_bits({"trans1": ["n", "wide"], "trans3": ["wide"], "trans4": ["n", "s", "wide", "narrow"]}, table.columns)
    kept = chosen_columns(effective_plan(bits, table, setting), table.columns)
    assert kept == {"trans1": ["n"], "trans2": [], "trans3": ["wide"], "trans4": ["s", "wide", "narrow"], "trans5": []}


def test_a_level_depends_on_its_own_columns_only():
    columns = ["a", "b", "c"]
    level = fit.Level(("a",), ("b",), 4)
    first = plan_bits({"trans1": ["b"], "trans4": ["c"]}, columns)
    second = plan_bits({"trans1": ["b"], "trans2": ["c"]}, columns)
    third = plan_bits({"trans1": ["b"], "trans4": ["b"]}, columns)
    assert search.level_input(first, columns, level) == search.level_input(second, columns, level)
    assert search.level_input(first, columns, level) != search.level_input(third, columns, level)


def test_levels_and_weights():
    levels = fit.column_levels(["a", "b", "c", "d"], ["a"], ["b"])
    assert [(lv.targets, lv.features, lv.weight) for lv in levels] == [
        (("a",), ("b",), 4),
        (("a",), ("a", "c", "d"), 3),
        (("c", "d"), ("b",), 2),
        (("b", "c", "d"), ("a", "c", "d"), 1),
    ]


def test_score_of_levels():
    results = [
        fit.LevelResult(4, {"tree": 0.7, "text": 0.4}),
        fit.LevelResult(3, {"tree": 0.5, "text": None}),
        fit.LevelResult(2, {"tree": float("nan"), "text": 0.2}),
        fit.LevelResult(1, {}),
    ]
    assert fit.score(results) == pytest.approx(0.6 / 6**1.5)
    assert fit.score(results[1:2]) is None
    assert fit.score([fit.LevelResult(4, {"tree": 0.0})]) is None


@pytest.fixture(scope="module")
def learnable(spark):
    rows = [(i, i % 2, float(i % 2), f"g{i % 3}", float(i % 7)) for i in range(120)]
    return spark.createDataFrame(rows, "id int, flag int, copy double, name string, other double").drop("id")


def test_fitness_of_a_learnable_table(learnable):
    levels = fit.column_levels(learnable.columns, ["flag"], ["copy", "name"])
    results = fit.plan_fitness(learnable, levels, models=["tree", "text"])
    assert [r.weight for r in results] == [4, 3, 2, 1]
    assert results[0].errors["tree"] == pytest.approx(0.0, abs=1e-9)
    assert fit.plan_fitness(learnable, levels, models=["tree", "text"])[0].errors == results[0].errors


@pytest.mark.parametrize("name", sorted(fit.FITNESS))
def test_each_model_is_repeatable(learnable, name):
    from tablewright.functions.features import label_features

    data = label_features(learnable, ["flag"], ["copy", "other"]).cache()
    first = fit.FITNESS[name](data, 5)
    assert first == fit.FITNESS[name](data, 5)
    assert 0 <= first < 0.6


def test_a_plan_without_rows_has_no_fitness(learnable):
    levels = fit.column_levels(learnable.columns, ["flag"], ["copy"])
    assert fit.score(fit.plan_fitness(learnable.limit(0), levels, models=["tree"])) is None


def ones(plan):
    return float(len(plan) - sum(plan))


def each(fitness):
    return lambda plans: [fitness(p) for p in plans]


def test_search_improves_and_counts_each_plan_once():
    calls = []

    def evaluate(plans):
        calls.extend(plans)
        return [ones(p) for p in plans]

    s = search.Search(evaluate, length=20, population=20, generations=15, seed=3)
    best = s.run()
    assert len(calls) == len(set(calls))
    assert s.best_fitness == ones(best) < min(ones(p) for p in calls[:20])
    bests = [g.best for g in s.history]
    assert bests == sorted(bests, reverse=True)
    assert search.Search(each(ones), length=20, population=20, generations=15, seed=3).run() == best


def plain_search(fitness, length, population, generations, rate, seed):
    """The search one plan at a time: (best fitness, plans seen) after every generation."""
    import random

    rng, seen, found = random.Random(seed), {}, []

    def of(plan):
        if plan not in seen:
            seen[plan] = fitness(plan)
        return seen[plan]

    plans = [tuple(rng.randint(0, 1) for _ in range(length)) for _ in range(population)]
    best = min(of(p) for p in plans)
    found.append((best, len(seen)))
    for _ in range(generations):
        half = sorted(plans, key=lambda p: (of(p), p))[: max(2, population // 2)]
        children = []
        for i, plan in enumerate(half):
            children += search.cross(plan, rng.choice([p for j, p in enumerate(half) if j != i]), rng)
        plans = []
        for child in children[:population]:
            changed = search.flip_one(child, rng) if rng.random() < rate else child
            plans.append(changed if of(changed) <= of(child) else child)
        best = min(best, *[of(p) for p in plans])
        found.append((best, len(seen)))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_generation_at_once_is_the_search_plan_by_plan(seed):
    def rough(plan):
        return float(sum((i * 7) % 5 * b for i, b in enumerate(plan))) / (1 + sum(plan))

    s = search.Search(each(rough), length=14, population=10, generations=20, seed=seed)
    s.run()
    assert [(g.best, g.evaluated) for g in s.history] == plain_search(rough, 14, 10, 20, 0.1, seed)


def test_a_generation_is_evaluated_in_one_call():
    calls = []

    def evaluate(plans):
        calls.append(len(plans))
        return [ones(p) for p in plans]

    search.Search(evaluate, length=30, population=20, generations=5, seed=3).run()
    assert len(calls) <= 6 and calls[0] == 20


def test_levels_with_the_same_data_are_one(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, 5, "a", None), (3, 6, "b", "y")], "a int, b int, c string, d string")
    setting = make_setting(df, sort=False)
    patterns = search.null_patterns(df, setting.nullable)
    assert patterns == {frozenset({"b", "c"}): 1, frozenset({"d"}): 1, frozenset(): 1}
    level = fit.Level(("a",), ("b", "c"), 4)

    def key(**chosen):
        return search.level_input(plan_bits(chosen, df.columns), df.columns, level, patterns, ["c", "d"])

    assert key(trans1=["b"]) == key(trans1=["c"]) == key(trans1=["b", "c"]) != key(trans1=["d"])
    assert key(trans4=["b"]) == key() != key(trans4=["c"])
    assert key(trans1=["b"], trans4=["c"]) == key(trans1=["b"])
    assert search.null_patterns(df.limit(0), ["b"]) == {} and search.null_patterns(df, []) == {frozenset(): 1}


def test_shared_levels_fit_alike(spark):
    """Plans whose level keys agree give the models the same rows."""
    from tablewright.functions.features import index_strings, label_features

    rows = [(i, None if i % 7 == 0 else i % 5, None if i % 7 == 0 else f"g{i % 3}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, c string, d double")
    setting = make_setting(df, sort=False)
    patterns, level = search.null_patterns(df, setting.nullable), fit.Level(("a",), ("b", "c"), 4)
    data = {}
    for chosen in ({"trans1": ["b"]}, {"trans1": ["c"]}, {}, {"trans4": ["b"]}, {"trans1": ["c"], "trans4": ["c"]}):
        plan = plan_bits(chosen, df.columns)
        key = search.level_input(plan, df.columns, level, patterns, ["c"])
        made = label_features(index_strings(apply_plan(df, plan, setting)), level.targets, level.features)
        found = [tuple(r) for r in made.collect()]
        assert data.setdefault(key, found) == found
    assert len(data) == 2


def test_search_ranks_plans_without_fitness_last():
    s = search.Search(each(lambda p: None if p[0] else ones(p)), length=6, population=10, generations=5, seed=1)
    assert s.run()[0] == 0


def test_crossing_keeps_length():
    import random

    a, b = (0,) * 8, (1,) * 8
    for seed in range(20):
        c, d = search.cross(a, b, random.Random(seed))
        assert len(c) == len(d) == 8
        assert tuple(x + y for x, y in zip(c, d)) == (1,) * 8


@pytest.mark.parametrize("key", ["q09_plan_search", "q09_plan_search_table"])
def test_registered_search_has_the_size_of_the_operator(spark, monkeypatch, key):
    import inspect
    from types import SimpleNamespace

    from tablewright.catalog import QUERIES, preparation

    asked = []

    def recorded(*args, **kwargs):
        asked.append(inspect.signature(search.plan_search).bind(*args, **kwargs))
        return SimpleNamespace(table=None, history=None)

    monkeypatch.setattr(preparation, "plan_search", recorded)
    QUERIES[key](spark, "/root/testdata/sf0.001")
    asked[0].apply_defaults()
    assert (asked[0].arguments["population"], asked[0].arguments["generations"]) == (100, 100)


def test_whole_search_returns_its_table(learnable):
    wanted = Actions(filters=[("name", "filter", "g2")], targets=["flag"], objects=["copy"])
    result = search.plan_search(learnable, wanted, population=3, generations=1, seed=2, models=["tree", "text"])
    assert result.history.count() == 2
    assert len(result.plan) == 5 * 4
    assert result.table.count() <= 80


@pytest.mark.parametrize("rows", [1, 2])
@pytest.mark.parametrize("name", sorted(fit.FITNESS))
def test_a_split_left_without_rows_has_no_error(spark, name, rows):
    data = spark.range(rows).selectExpr("double(id) AS label", "array(double(id), 1.0D) AS f")
    data = data.select("label", array_to_vector("f").alias("features")).persist()
    for seed in (1, 2, 3):
        train, test = data.randomSplit([0.6 if name == "perceptron" else 0.7, 0.4 if name == "perceptron" else 0.3], seed)
        error = fit.FITNESS[name](data, seed)
        assert (error is None) == (train.isEmpty() or test.isEmpty())
    data.unpersist()
