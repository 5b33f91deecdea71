"""Queries of group K: feature extraction, transformation and selection."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.catalog.aggregations import TITLE_TOKENS_SQL
from tablewright.catalog.registry import Tables, query
from tablewright.functions import features as ft, text
from tablewright.learning import spectral
from tablewright.storage import cut_lineage

# Words as the white-space tokenizer makes them: trailing blanks give no word.
WORDS_SQL = r"""SELECT doc_id, string_split_regex(regexp_replace(lower(text), '\s+$', ''), '\s') AS words
  FROM documents"""


def codes_sql(table: str, column: str) -> str:
    return f"""SELECT {column} AS value,
      CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS DOUBLE) AS code
      FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}"""


def slots_sql(table: str, key: str, values: list[str], digits: int = 6) -> str:
    """One row per slot of a vector of expressions."""
    listed = ", ".join(f"CAST({v} AS DOUBLE)" for v in values)
    positions = ", ".join(str(i) for i in range(len(values)))
    return f"""SELECT {key}, pos, round(v, {digits}) AS value FROM (
      SELECT {key}, unnest([{positions}]) AS pos, unnest([{listed}]) AS v FROM {table})"""


def part_vector(t: Tables):
    return ft.assemble(t.part, ["p_size", "p_retailprice"]).select("p_partkey", "features")


def line_vector(t: Tables):
    names = ["l_quantity", "l_discount", "l_tax"]
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    return ft.assemble(t.lineitem.select(*keys, *names), names)


@query(
    "k01_tfidf",
    f"""WITH counts AS (SELECT doc_id, token AS term, count(*) AS tf FROM ({TITLE_TOKENS_SQL}) GROUP BY ALL),
        spread AS (SELECT term, count(*) AS df FROM counts GROUP BY term)
        SELECT doc_id, term, tf, round(tf * CASE WHEN df >= 4
          THEN ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) ELSE 0 END, 6) AS tfidf
        FROM counts JOIN spread USING (term)""",
)
def tfidf(t: Tables):
    tokens = text.title_token_rows(t.documents, "doc_id", "text")
    weighted = text.tfidf(tokens, "doc_id", t.documents, 4)
    return weighted.withColumn("tfidf", F.round("tfidf", 6))


@query("k01_tfidf_hashed")
def tfidf_hashed(t: Tables):
    docs = t.documents.select("doc_id", text.message_tokens(F.col("text")).alias("tokens"))
    weighted = ft.hashed_tfidf(docs, "tokens", 1 << 10, 4)
    values = vector_to_array("tfidf")
    return weighted.select(
        "doc_id",
        F.size("tokens").alias("tokens"),
        F.size(F.filter(values, lambda v: v > 0)).alias("slots"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
    )


def _documents_as_words(t: Tables):
    """Words of every document, written once: learning and transforming read them three times."""
    return cut_lineage(t.documents.select("doc_id", text.title_tokens(F.col("text")).alias("words")), "document-words")


@query("k02_word2vec")
def word2vec(t: Tables):
    docs = _documents_as_words(t)
    model = ft.word2vec_model(docs, "words", size=3, seed=2)
    return ft.vector_rows(model.transform(docs), ["doc_id"], "vector", 4)


@query("k02_word2vec_synonyms")
def synonyms(t: Tables):
    docs = _documents_as_words(t)
    model = ft.word2vec_model(docs, "words", size=16, seed=2)
    words = docs.select(F.explode("words").alias("word")).groupBy("word").count()
    most = words.orderBy(F.col("count").desc(), "word").first()["word"]
    return model.findSynonyms(most, 5)


@query(
    "k03_count_vectorizer",
    f"""WITH counts AS (SELECT doc_id, token AS term, count(*) AS tf FROM ({TITLE_TOKENS_SQL}) GROUP BY ALL)
        SELECT doc_id, term, tf FROM counts
        WHERE term IN (SELECT term FROM counts GROUP BY term HAVING count(*) >= 2)""",
)
def count_terms(t: Tables):
    return text.count_terms(text.title_token_rows(t.documents, "doc_id", "text"), "doc_id", 2)


@query(
    "k03_count_vectorizer_learnt",
    f"""WITH counts AS (SELECT doc_id, unnest(words) AS term FROM ({WORDS_SQL})),
          terms AS (SELECT term, count(*) AS n FROM counts GROUP BY term HAVING count(DISTINCT doc_id) >= 3),
          codes AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS code FROM terms)
        SELECT doc_id, code, term, count(*) AS n FROM counts JOIN codes USING (term) GROUP BY ALL""",
)
def count_learnt(t: Tables):
    docs = ft.tokenize(t.documents.select("doc_id", "text"), "text")
    return ft.learnt_counts(docs, "doc_id", "words", least_documents=3.0).withColumnRenamed("row", "doc_id")


@query(
    "k03_count_vocabulary",
    f"""SELECT doc_id, pos, CAST(len(list_filter(words, lambda w: w = ['the', 'and', 'of'][pos + 1])) AS DOUBLE) AS value
        FROM ({WORDS_SQL}), (SELECT unnest([0, 1, 2]) AS pos)""",
)
def count_vocabulary(t: Tables):
    docs = ft.tokenize(t.documents.select("doc_id", "text"), "text")
    counted = ft.count_vectors(docs, "words", vocabulary=["the", "and", "of"])
    return ft.vector_rows(counted, ["doc_id"], "counts")


@query(
    "k04_tokenizer",
    f"SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM ({WORDS_SQL})) GROUP BY word",
)
def tokenizer(t: Tables):
    words = ft.tokenize(t.documents.select("text"), "text")
    return text_counts(words.select(F.explode("words").alias("word")), "word")


def text_counts(df, name):
    return df.groupBy(name).agg(F.count("*").alias("n"))


@query(
    "k05_regex_tokenizer",
    r"""SELECT word, count(*) AS n FROM (
          SELECT unnest(string_split_regex(lower(text), '\W')) AS word FROM documents)
        WHERE word <> '' GROUP BY word""",
)
def regex_tokenizer(t: Tables):
    words = ft.regex_tokenize(t.documents.select("text"), "text")
    return text_counts(words.select(F.explode("words").alias("word")), "word")


@query(
    "k06_stop_words",
    f"""SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM ({WORDS_SQL}))
        WHERE word NOT IN ('the', 'and', 'of', 'der', 'la', 'que') GROUP BY word""",
)
def stop_words(t: Tables):
    words = ft.tokenize(t.documents.select("text"), "text")
    kept = ft.remove_stop_words(words, "words", stop_words=["the", "and", "of", "der", "la", "que"])
    return text_counts(kept.select(F.explode("filtered").alias("word")), "word")


@query(
    "k07_ngrams",
    f"""SELECT ngram, count(*) AS n FROM (
          SELECT unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS ngram
          FROM ({WORDS_SQL})) GROUP BY ngram""",
)
def ngrams(t: Tables):
    words = ft.tokenize(t.documents.select("text"), "text")
    pairs = ft.ngrams(words.select("words"), "words", 2)
    return text_counts(pairs.select(F.explode("ngrams").alias("ngram")), "ngram")


@query(
    "k08_binarizer",
    """SELECT l_orderkey, l_discount, CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag
       FROM lineitem""",
)
def binarizer(t: Tables):
    return ft.binarize(t.lineitem.select("l_orderkey", "l_discount"), "l_discount", 0.05)


@query("k09_pca")
def pca(t: Tables):
    model = spectral.principal_components(t.embeddings, "embedding", 4)
    projected = model.transform(t.embeddings, "embedding").select("vec_id", F.posexplode("pca").alias("pos", "value"))
    return projected.withColumn("value", F.abs("value"))


@query("k09_pca_variance")
def pca_variance(t: Tables):
    shares = spectral.principal_components(t.embeddings, "embedding", 5).explained
    rows = [(i, round(float(v), 6)) for i, v in enumerate(shares)]
    return t.spark.createDataFrame(rows, "component int, explained double")


PAIR_SQL = """WITH s AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_tax) AS b, var_samp(l_tax) AS c FROM lineitem),
  e AS (SELECT (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) AS top, a + c AS whole FROM s)"""


@query(
    "k09_pca_variance_pair",
    f"""{PAIR_SQL} SELECT 0 AS component, round(top / whole, 6) AS explained FROM e
        UNION ALL SELECT 1, round(1 - top / whole, 6) FROM e""",
)
def pca_variance_pair(t: Tables):
    """Two columns have a closed form."""
    pairs = t.lineitem.select(F.array(F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")).alias("v"))
    shares = spectral.principal_components(pairs, "v", 2).explained
    df = t.spark.createDataFrame([(i, float(v)) for i, v in enumerate(shares)], "component int, explained double")
    return df.withColumn("explained", F.round("explained", 6))


@query(
    "k10_polynomial_expansion",
    slots_sql(
        f"(SELECT p_partkey, CAST(p_size AS DOUBLE) / 10 AS x, p_retailprice / 1000 AS y FROM part)",
        "p_partkey",
        ["x", "x*x", "x*x*x", "y", "x*y", "x*x*y", "y*y", "x*y*y", "y*y*y"],
        9,
    ),
)
def polynomial(t: Tables):
    rows = t.part.select(
        "p_partkey", (F.col("p_size") / 10).alias("x"), (F.col("p_retailprice") / 1000).alias("y")
    )
    expanded = ft.polynomial(ft.assemble(rows, ["x", "y"]), "features", 3)
    return ft.vector_rows(expanded, ["p_partkey"], "expanded", 9)


@query(
    "k11_dct",
    """SELECT vec_id, CAST(k AS INTEGER) AS pos, round(sqrt(2.0 / 64) * CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1 END *
         sum(x * cos(pi() * (n + 0.5) * k / 64)), 6) + 0.0 AS value
       FROM (SELECT vec_id, unnest(range(64)) AS n, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
            (SELECT unnest(range(64)) AS k)
       GROUP BY vec_id, k""",
)
def dct(t: Tables):
    vectors = ft.array_vector(t.embeddings, "embedding")
    return ft.vector_rows(ft.dct(vectors, "features"), ["vec_id"], "dct")


@query(
    "k12_string_indexer",
    f"""SELECT p_partkey, p_name, code AS name_index FROM part
        JOIN ({codes_sql('part', 'p_name')}) ON p_name = value""",
)
def string_indexer(t: Tables):
    return ft.index_column(t.part.select("p_partkey", "p_name"), "p_name", "name_index")


@query("k13_index_to_string", "SELECT p_partkey, p_brand AS brand FROM part")
def index_to_string(t: Tables):
    codes = ft.category_codes(t.part, "p_brand")
    indexed = ft.index_column(t.part.select("p_partkey", "p_brand"), "p_brand", "code_index", codes)
    return ft.unindex_column(indexed.drop("p_brand"), "code_index", codes, "brand").drop("code_index")


@query(
    "k14_one_hot",
    f"""SELECT o_orderkey, CAST(pos AS INTEGER) AS pos, CASE WHEN code = pos THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
        FROM orders JOIN ({codes_sql('orders', 'o_orderpriority')}) ON o_orderpriority = value,
        (SELECT unnest(range((SELECT count(DISTINCT o_orderpriority) FROM orders) - 1)) AS pos)""",
)
def one_hot(t: Tables):
    indexed = ft.index_column(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code")
    return ft.vector_rows(ft.one_hot(indexed, "code"), ["o_orderkey"], "onehot")


@query(
    "k15_vector_indexer",
    """WITH rows AS (SELECT l_orderkey, l_partkey, l_linenumber - 3 AS a, l_extendedprice AS b FROM lineitem),
       codes AS (SELECT a, CASE WHEN a = 0 THEN 0 ELSE
           row_number() OVER (ORDER BY CASE WHEN a = 0 THEN 0 ELSE 1 END, a) - 1 END AS code
         FROM (SELECT DISTINCT a FROM rows))
       SELECT l_orderkey, l_partkey, pos, CASE pos WHEN 0 THEN CAST(code AS DOUBLE) ELSE b END AS value
       FROM rows JOIN codes USING (a), (SELECT unnest([0, 1]) AS pos)""",
)
def vector_indexer(t: Tables):
    rows = t.lineitem.select(
        "l_orderkey", "l_partkey", (F.col("l_linenumber") - 3).alias("a"), F.col("l_extendedprice").alias("b")
    )
    indexed = ft.index_slots(ft.assemble(rows, ["a", "b"]), "features", 10)
    return ft.vector_rows(indexed, ["l_orderkey", "l_partkey"], "indexed")


def _size_and_price(p: str) -> str:
    return slots_sql("part", "p_partkey", [f"p_size / ({p})", f"p_retailprice / ({p})"], 9)


@query("k16_normalizer_l1", _size_and_price("p_size + p_retailprice"))
def normalizer_l1(t: Tables):
    return ft.vector_rows(ft.normalize(part_vector(t), "features", 1.0), ["p_partkey"], "normed", 9)


@query("k16_normalizer_max", _size_and_price("greatest(p_size, p_retailprice)"))
def normalizer_max(t: Tables):
    normed = ft.normalize(part_vector(t), "features", math.inf)
    return ft.vector_rows(normed, ["p_partkey"], "normed", 9)


LINES = "lineitem, (SELECT {} FROM lineitem)"
LINE_KEYS = "l_orderkey, l_partkey, l_linenumber"


@query(
    "k17_standard_scaler",
    slots_sql(
        LINES.format("stddev_samp(l_quantity) AS q, stddev_samp(l_discount) AS d, stddev_samp(l_tax) AS x"),
        LINE_KEYS,
        ["l_quantity / q", "l_discount / d", "l_tax / x"],
    ),
)
def standard_scaler(t: Tables):
    scaled = ft.scale_standard(line_vector(t), "features")
    return ft.vector_rows(scaled, LINE_KEYS.split(", "), "scaled")


@query(
    "k18_minmax_scaler",
    slots_sql(
        LINES.format(
            "min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1,"
            " min(l_tax) AS x0, max(l_tax) AS x1"
        ),
        LINE_KEYS,
        ["(l_quantity - q0) / (q1 - q0)", "(l_discount - d0) / (d1 - d0)", "(l_tax - x0) / (x1 - x0)"],
    ),
)
def minmax_scaler(t: Tables):
    return ft.vector_rows(ft.scale_minmax(line_vector(t), "features"), LINE_KEYS.split(", "), "scaled")


@query(
    "k19_maxabs_scaler",
    slots_sql(
        "customer, (SELECT max(abs(c_acctbal)) AS a, max(abs(c_nationkey)) AS n FROM customer)",
        "c_custkey",
        ["c_acctbal / a", "c_nationkey / n"],
    ),
)
def maxabs_scaler(t: Tables):
    vectors = ft.assemble(t.customer, ["c_acctbal", "c_nationkey"])
    return ft.vector_rows(ft.scale_maxabs(vectors, "features"), ["c_custkey"], "scaled")


@query(
    "k20_bucketizer",
    """SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 0 WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 500 THEN 2
         WHEN c_acctbal < 5000 THEN 3 ELSE 4 END::DOUBLE AS bucket FROM customer""",
)
def bucketizer(t: Tables):
    splits = [-math.inf, -500.0, 0.0, 500.0, 5000.0, math.inf]
    return ft.bucketize(t.customer, "c_acctbal", splits).select("c_custkey", "bucket")


@query(
    "k21_elementwise_product",
    slots_sql("part", "p_partkey", ["p_size * 0.5", "p_retailprice * 2"]),
)
def elementwise(t: Tables):
    product = ft.elementwise_product(part_vector(t), "features", [0.5, 2.0])
    return ft.vector_rows(product, ["p_partkey"], "product")


@query(
    "k22_vector_assembler",
    """SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v, 6) AS value FROM (SELECT vec_id, unnest(range(66)) AS pos,
         unnest(list_concat([CAST(label AS DOUBLE)], CAST(embedding AS DOUBLE[]), [CAST(vec_id AS DOUBLE)])) AS v
       FROM embeddings)""",
)
def assembler(t: Tables):
    vectors = ft.array_vector(t.embeddings, "embedding", "inner")
    return ft.vector_rows(ft.assemble(vectors, ["label", "inner", "vec_id"]), ["vec_id"], "features")


@query(
    "k23_quantile_discretizer",
    """WITH ranked AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) AS rn FROM customer),
       borders AS (SELECT min(v) FILTER (WHERE rn >= ceil(n / 3.0)) AS b1,
           min(v) FILTER (WHERE rn >= ceil(2 * n / 3.0)) AS b2
         FROM ranked, (SELECT count(*) AS n FROM customer))
       SELECT c_custkey, CAST(CASE WHEN c_acctbal >= b2 THEN 2 WHEN c_acctbal >= b1 THEN 1 ELSE 0 END AS DOUBLE)
         AS bucket FROM customer, borders""",
)
def quantiles(t: Tables):
    return ft.quantile_buckets(t.customer, "c_acctbal", 3).select("c_custkey", "bucket")


@query(
    "k24_vector_slicer",
    slots_sql("part", "p_partkey", ["p_retailprice", "p_partkey"]),
)
def slicer(t: Tables):
    vectors = ft.assemble(t.part, ["p_partkey", "p_size", "p_retailprice"])
    sliced = ft.slice_vector(vectors, "features", indices=[2], names=["p_partkey"])
    return ft.vector_rows(sliced, ["p_partkey"], "sliced")


@query(
    "k25_r_formula",
    f"""SELECT o_orderkey, o_totalprice AS label, pos, CASE WHEN pos < 2
          THEN CASE WHEN code = pos THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE CAST(o_custkey AS DOUBLE) END AS value
        FROM orders JOIN ({codes_sql('orders', 'o_orderstatus')}) ON o_orderstatus = value,
        (SELECT unnest([0, 1, 2]) AS pos)""",
)
def formula(t: Tables):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    made = ft.apply_formula(rows, "o_totalprice ~ o_orderstatus + o_custkey")
    return ft.vector_rows(made, ["o_orderkey", "label"], "features")


@query("k26_chisq_selector")
def chi_square_selector(t: Tables):
    rows = t.lineitem.select(
        "l_returnflag",
        "l_linenumber",
        F.round(F.col("l_tax") * 100).alias("tax"),
        F.round(F.col("l_discount") * 100).alias("discount"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity") % 5).otherwise(0).alias("planted"),
    )
    coded = ft.index_strings(rows)
    vectors = ft.assemble(coded, ["l_linenumber", "tax", "discount", "planted"])
    model = ft.select_by_chi_square(vectors, "features", "l_returnflag", 2)
    rows = [(int(i),) for i in model.selectedFeatures]
    return t.spark.createDataFrame(rows, "slot int")


@query(
    "k27_label_features",
    f"""WITH status AS ({codes_sql('orders', 'o_orderstatus')}), priority AS ({codes_sql('orders', 'o_orderpriority')})
        SELECT o_orderkey, o_totalprice AS label, pos, CASE pos WHEN 0 THEN s.code WHEN 1 THEN p.code
          ELSE CASE WHEN o_custkey % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(o_custkey AS DOUBLE) END END AS value
        FROM orders JOIN status s ON o_orderstatus = s.value JOIN priority p ON o_orderpriority = p.value,
        (SELECT unnest([0, 1, 2]) AS pos)""",
)
def labelled(t: Tables):
    rows = t.orders.withColumn("o_custkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")))
    made = ft.label_features(
        rows,
        ["missing", "o_totalprice"],
        ["o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice", "absent"],
        keep=["o_orderkey"],
    )
    return ft.vector_rows(made, ["o_orderkey", "label"], "features")


@query(
    "k28_all_strings_categorical",
    f"""SELECT c_custkey, n.code AS c_name, c_nationkey, c_acctbal, s.code AS c_mktsegment FROM customer
        JOIN ({codes_sql('customer', 'c_name')}) n ON c_name = n.value
        JOIN ({codes_sql('customer', 'c_mktsegment')}) s ON c_mktsegment = s.value""",
)
def all_strings(t: Tables):
    return ft.index_strings(t.customer, keep_null=True)
