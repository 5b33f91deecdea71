"""Encoders and text functions on the published small examples."""

from __future__ import annotations

import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.functions import features as ft, scalars, text
from tablewright.learning import spectral


def values(df, column):
    return [list(r[column].toArray()) for r in df.collect()]


@pytest.fixture
def letters(spark):
    return spark.createDataFrame(list(enumerate("abcaac")), "id int, letter string")


def test_binarizer(spark):
    df = spark.createDataFrame([(0.1,), (0.8,), (0.2,)], "x double")
    assert [r["flag"] for r in ft.binarize(df, "x", 0.5).collect()] == [0.0, 1.0, 0.0]


def test_bucketizer(spark):
    df = spark.createDataFrame([(-0.5,), (-0.3,), (0.0,), (0.2,)], "x double")
    splits = [-math.inf, -0.5, 0.0, 0.5, math.inf]
    assert [r["bucket"] for r in ft.bucketize(df, "x", splits).collect()] == [1.0, 1.0, 2.0, 2.0]


def test_elementwise_product(spark):
    df = spark.createDataFrame([(Vectors.dense(1, 2, 3),), (Vectors.dense(4, 5, 6),)], ["v"])
    assert values(ft.elementwise_product(df, "v", [0, 1, 2]), "product") == [[0, 2, 6], [0, 5, 12]]


def test_polynomial_expansion(spark):
    df = spark.createDataFrame([(Vectors.dense(-2.0, 2.3),)], ["v"])
    x, y = -2.0, 2.3
    expected = [x, x**2, x**3, y, x * y, x * x * y, y * y, x * y * y, y**3]
    assert values(ft.polynomial(df, "v", 3), "expanded")[0] == pytest.approx(expected)


def test_dct(spark):
    row = [0.0, 1.0, -2.0, 3.0]
    df = spark.createDataFrame([(Vectors.dense(row),)], ["v"])
    expected = [
        math.sqrt(2 / 4) * (math.sqrt(0.5) if k == 0 else 1) * sum(x * math.cos(math.pi * (n + 0.5) * k / 4) for n, x in enumerate(row))
        for k in range(4)
    ]
    assert values(ft.dct(df, "v"), "dct")[0] == pytest.approx(expected)


def test_string_codes_and_back(spark, letters):
    codes = ft.category_codes(letters, "letter")
    assert {r["value"]: r["code"] for r in codes.collect()} == {"a": 0.0, "c": 1.0, "b": 2.0}
    indexed = ft.index_column(letters, "letter", "code", codes)
    back = ft.unindex_column(indexed, "code", codes, "again")
    assert all(r["letter"] == r["again"] for r in back.collect())


def test_one_hot_drops_the_last(spark, letters):
    indexed = ft.index_column(letters, "letter", "code")
    out = {r["letter"]: list(r["onehot"].toArray()) for r in ft.one_hot(indexed, "code").collect()}
    assert out == {"a": [1, 0], "c": [0, 1], "b": [0, 0]}


@pytest.mark.parametrize("limit", [10_000, 0])
def test_index_strings_alike_on_both_routes(spark, monkeypatch, limit):
    monkeypatch.setattr(ft, "DRIVER_CATEGORIES", limit)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, s string")
    plain = {r["id"]: r["s"] for r in ft.index_strings(df).collect()}
    assert plain == {1: 0.0, 2: 1.0, 3: 0.0, 4: None}
    kept = {r["id"]: r["s"] for r in ft.index_strings(df, keep_null=True).collect()}
    assert kept == {1: 0.0, 2: 1.0, 3: 0.0, 4: 2.0}


def test_label_features_fill_nulls_and_skip_absent_columns(spark):
    df = spark.createDataFrame([(1.5, None, "x"), (None, 2, "y"), (2.5, 3, "x")], "t double, n int, s string")
    out = ft.label_features(df, ["none", "t"], ["n", "s", "t"]).collect()
    assert sorted((r["label"], *r["features"]) for r in out) == [(0.0, 2.0, 1.0), (1.5, 0.0, 0.0), (2.5, 3.0, 0.0)]
    with pytest.raises(ValueError):
        ft.label_features(df, ["none"], ["n"])


def test_quantile_buckets(spark):
    df = spark.createDataFrame([(18.0,), (19.0,), (8.0,), (5.0,), (2.2,)], "hour double")
    out = {r["hour"]: r["bucket"] for r in ft.quantile_buckets(df, "hour", 3).collect()}
    # ranks ceil(5/3) = 2 and ceil(10/3) = 4: borders 5 and 18
    assert out == {2.2: 0.0, 5.0: 1.0, 8.0: 1.0, 18.0: 2.0, 19.0: 2.0}


def test_constant_slot_scales_to_half(spark):
    df = spark.createDataFrame([(Vectors.dense(1.0, 5.0),), (Vectors.dense(3.0, 5.0),)], ["v"])
    assert values(ft.scale_minmax(df, "v"), "scaled") == [[0.0, 0.5], [1.0, 0.5]]


def test_counts_over_small_vocabulary(spark):
    df = spark.createDataFrame([(0, list("abc")), (1, list("abbca"))], "id int, words array<string>")
    out = values(ft.count_vectors(df, "words", vocabulary=["a", "b", "c"]).orderBy("id"), "counts")
    assert out == [[1, 1, 1], [2, 2, 1]]
    learnt = ft.count_vectors(df, "words", size=3, least_documents=2.0)
    assert sorted(sum(v) for v in values(learnt, "counts")) == [3, 5]


def test_sql_stage(spark):
    df = spark.createDataFrame([(0, 1.0, 3.0), (2, 2.0, 5.0)], "id int, v1 double, v2 double")
    out = ft.run_statement(df, "SELECT *, (v1 + v2) AS v3, (v1 * v2) AS v4 FROM __THIS__")
    assert [(r["v3"], r["v4"]) for r in out.collect()] == [(4.0, 3.0), (7.0, 10.0)]


def test_title_tokens(spark):
    df = spark.createDataFrame([("The Driver, 2nd shift! a B",)], "t string")
    assert df.select(text.title_tokens(F.col("t")).alias("x")).first()["x"] == ["driver", "shift"]


def test_clean_tokens_drop_rare_words(spark):
    df = spark.createDataFrame([(1, "night driver wanted"), (2, "driver, night"), (3, "unique")], "id int, t string")
    tokens = text.clean_tokens(df, "id", "t")
    arrays = {r["id"]: r["tokens"] for r in text.token_arrays(tokens, "id").collect()}
    assert arrays == {1: ["night", "driver"], 2: ["driver", "night"]}


def test_clean_tokens_spread_a_common_word(spark):
    """No task of the join gets all rows of one word, and the tokens stay the same."""
    df = spark.range(0, 4000, 1, 4).select("id", F.concat(F.lit("driver driver w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("t"))
    df = df.unionByName(spark.createDataFrame([(None, "driver only"), (None, None)], "id long, t string"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        tokens = text.clean_tokens(df, "id", "t")
        got = tokens.groupBy("token").count().collect()
        parts = [r["n"] for r in tokens.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {r["token"]: r["count"] for r in got} == {"driver": 8001}
    assert max(parts) < 4000
    assert sorted(r["pos"] for r in tokens.where("id is null or id = 7").collect()) == [0, 0, 1]


def test_message_tokens(spark):
    df = spark.createDataFrame([("Win! WIN a (free) prize-now, at 10:00 in the box",)], "t string")
    out = df.select(text.message_tokens(F.col("t")).alias("x")).first()["x"]
    assert out == ["win", "free", "prize", "now", "box"]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "cat cat dog"), (2, "cat bird")], "id int, t string")
    out = text.tfidf(text.title_token_rows(df, "id", "t"), "id", df).collect()
    got = {(r["id"], r["term"]): r["tfidf"] for r in out}
    assert got[(1, "cat")] == pytest.approx(2 * math.log(3 / 3))
    assert got[(1, "dog")] == pytest.approx(math.log(3 / 2))


def test_uri_component(spark):
    df = spark.createDataFrame([("a b+c!'()~*é/",)], "u string")
    out = df.select(scalars.encode_uri_component(F.col("u")).alias("x")).first()["x"]
    assert out == "a%20b%2Bc!'()~*%C3%A9%2F"


def test_refined_date(spark):
    df = spark.createDataFrame([("02/08/2015 11:43:58 PM",), ("bad",)], "d string")
    row, bad = scalars.refine_date(df, "d").collect()
    assert (row["Year"], row["Month"], row["Day"], row["HourOfDay"]) == (2015, 2, 8, 23)
    assert (row["WeekNum"], row["Weekend"], row["Season"], row["WeekDay"]) == (6, 1, "Winter", 7)
    assert bad["Year"] is None


def test_labels_of_negative_numbers(spark):
    df = spark.createDataFrame([(-3.7,), (4.2,), (0.0,)], "x double")
    out = df.select(scalars.label_parity(F.col("x")).alias("p"), scalars.label_thirds(F.col("x")).alias("q"))
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 1), (0, 0)]


def test_word2vec_means_and_unknown_words(spark):
    df = spark.createDataFrame([(["a", "b"] * 20,), (["zzz"],)], "words array<string>")
    model = ft.word2vec_model(df, "words", size=3, least_count=5)
    known, unknown = model.transform(df).select("vector").collect()
    assert list(unknown["vector"]) == [0.0, 0.0, 0.0]
    assert any(known["vector"])


def test_pca_of_the_published_vectors(spark):
    rows = [([0.0, 1.0, 0.0, 7.0, 0.0],), ([2.0, 0.0, 3.0, 4.0, 5.0],), ([4.0, 0.0, 0.0, 6.0, 7.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    model = spectral.principal_components(df, "v", 3)
    shares = model.explained
    assert sum(shares) == pytest.approx(1.0)
    assert all(a >= b for a, b in zip(shares, shares[1:]))


def test_learnt_vocabulary(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["a", "b", "b", "c", "a", None]), (3, []), (4, None), (5, ["b"])]
    df = spark.createDataFrame(rows, "id int, words array<string>")
    counted = {(r["row"], r["term"]): (r["code"], r["n"]) for r in ft.learnt_counts(df, "id", "words", least_documents=2).collect()}
    assert counted == {(1, "a"): (1, 1), (1, "b"): (0, 1), (1, "c"): (2, 1), (2, "a"): (1, 2), (2, "b"): (0, 2), (2, "c"): (2, 1), (5, "b"): (0, 1)}
    vectors = {r["id"]: r["counts"].toArray().tolist() for r in ft.count_vectors(df, "words").collect()}
    assert vectors == {1: [1, 1, 1], 2: [2, 2, 1], 3: [0, 0, 0], 4: [0, 0, 0], 5: [1, 0, 0]}
    few = ft.count_vectors(df, "words", size=1).where("id = 2").first()["counts"]
    assert few.size == 1 and few[0] == 2
    half = ft.learnt_counts(df, "id", "words", least_documents=0.5).select("term").distinct().collect()
    assert [r["term"] for r in half] == ["b"]


def test_terms_of_rows_are_kept_in_order(spark, monkeypatch):
    """The table of a row's terms is written by term, which packs it tighter than any other order."""
    written = {}
    plain = ft.cut_lineage

    def kept(df, label):
        written[label] = plain(df, label)
        return written[label]

    monkeypatch.setattr(ft, "cut_lineage", kept)
    df = spark.range(0, 200, 1, 4).select("id", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("t"), (i * 7 + F.col("id")) % 50)).alias("words"))
    assert ft.learnt_counts(df, "id", "words").agg(F.sum("n")).first()[0] == 4000
    parts = {}
    for r in written["row-terms"].select(F.input_file_name().alias("f"), "term").collect():
        parts.setdefault(r["f"], []).append(r["term"])
    assert parts and all(terms == sorted(terms) for terms in parts.values())


def test_hashed_terms_fall_where_a_plain_hash_puts_them(spark):
    """Buckets are the murmur3 of the term modulo their number, as plain Python computes it."""

    def murmur(data: bytes, seed: int = 42) -> int:
        def turn(x, r):
            return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF

        h = seed
        for at in range(0, len(data) // 4 * 4, 4):
            k = turn(int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
            h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        k = int.from_bytes(data[len(data) // 4 * 4 :], "little")
        if len(data) % 4:
            h ^= turn(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h ^= len(data)
        for factor, shift in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
            h = ((h ^ (h >> shift)) * factor) & 0xFFFFFFFF
        h ^= h >> 16
        return h - (1 << 32) if h >> 31 else h

    docs = [(1, ["the", "cat", "größer", "the"]), (2, ["cat", "a"]), (3, ["the"])]
    got = {r["id"]: r["tfidf"] for r in ft.hashed_tfidf(spark.createDataFrame(docs, "id int, words array<string>"), "words", buckets=16).collect()}
    want = {}
    for i, words in docs:
        for w in words:
            want.setdefault(i, {}).setdefault(murmur(w.encode()) % 16, []).append(w)
    held = {b: sum(b in v for v in want.values()) for v in want.values() for b in v}
    for i, buckets in want.items():
        exact = {b: len(words) * math.log(4 / (held[b] + 1)) for b, words in buckets.items()}
        assert {b: got[i][b] for b in exact} == pytest.approx(exact)
        assert sum(got[i].toArray()) == pytest.approx(sum(exact.values()))


def test_learnt_counts_keep_every_term(spark):
    # One term more than the vocabulary CountVectorizer takes by itself.
    df = spark.range(0, (1 << 18) + 1, 1, 4).selectExpr("array(concat('t', id)) AS words")
    counts = ft.count_vectors(df, "words").select("counts")
    assert counts.first().counts.size == (1 << 18) + 1
