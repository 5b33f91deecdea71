"""Queries of groups L, M and P: models and patterns."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.analysis import evaluation, sampling, summary
from tablewright.catalog.aggregations import TITLE_TOKENS_SQL
from tablewright.catalog.registry import Tables, query
from tablewright.functions import features as ft, text
from tablewright.learning import classification as cl, clustering, regression as rg, spectral, topics
from tablewright.operators import patterns
from tablewright.storage import cut_lineage, recorded, remove, shuffles_removed

# --- inputs -----------------------------------------------------------------


def line_rows(t: Tables, label, *features):
    """Lines with a label and a feature vector."""
    named = {f"f{i}": f for i, f in enumerate(features)}
    rows = t.lineitem.select("l_orderkey", label.cast("double").alias("label"), *[
        f.cast("double").alias(n) for n, f in named.items()
    ])
    return ft.assemble(rows, list(named)).select("l_orderkey", "label", "features")


def flag_rows(t: Tables):
    """Whether a line is closed, from its size, price and ship year."""
    return line_rows(
        t,
        F.when(F.col("l_quantity") + F.col("l_tax") * 200 > 34, 1).otherwise(0),
        F.col("l_quantity"),
        F.col("l_extendedprice"),
        F.col("l_linenumber"),
        F.year("l_shipdate"),
    )


def price_rows(t: Tables):
    """Discounted price from quantity, list price and discount."""
    return line_rows(
        t,
        F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000,
        F.col("l_quantity"),
        F.col("l_extendedprice") / 1000,
        F.col("l_discount"),
        F.col("l_linenumber"),
    )


def embedding_rows(t: Tables):
    return ft.array_vector(t.embeddings, "embedding").select(
        "vec_id", F.col("label").cast("double").alias("label"), "features"
    )


def text_rows(t: Tables):
    return t.documents.select("doc_id", "text").join(t.labels, "doc_id").select(
        "doc_id", "text", F.col("quality").cast("double").alias("label")
    )


def test_scores(t, learner, rows, key, share):
    train, test = sampling.hash_split(rows, key, share)
    return evaluation.classification_scores(learner.fit(train).transform(test))


def test_errors(learner, rows, key, share):
    train, test = sampling.hash_split(rows, key, share)
    return evaluation.regression_errors(learner.fit(train).transform(test))


# --- classification ---------------------------------------------------------


@query("l01_logistic_regression")
def logistic_regression(t: Tables):
    rows = flag_rows(t)
    model = cl.logistic(rows, max_iter=30, reg=0.1, threshold=0.55, probability="chance")
    scored = model.transform(rows)
    return scored.groupBy("label", "prediction").agg(
        F.count("*").alias("n"), F.avg(vector_to_array("chance")[1]).alias("chance")
    )


@query("l02_text_classifier")
def text_classifier(t: Tables):
    labelled = text_rows(t)
    unseen = t.documents.join(t.labels, "doc_id", "left_anti")
    model = cl.text_classifier().fit(labelled)
    scored = cl.score_rows(model, unseen.select("doc_id", "text"))
    return scored.select("doc_id", "prediction", "p")


@query("l03_decision_tree_classifier")
def decision_tree_classifier(t: Tables):
    return test_scores(t, cl.decision_tree(), flag_rows(t), "l_orderkey", 0.7)


@query("l04_random_forest_classifier")
def random_forest_classifier(t: Tables):
    return test_scores(t, cl.random_forest(10), flag_rows(t), "l_orderkey", 0.7)


@query("l05_gbt_classifier")
def gbt_classifier(t: Tables):
    return test_scores(t, cl.boosted_trees(10, 6), flag_rows(t), "l_orderkey", 0.7)


@query("l06_mlp_classifier")
def mlp_classifier(t: Tables):
    learner = cl.perceptron([64, 20, 10, 10], max_iter=100)
    return test_scores(t, learner, embedding_rows(t), "vec_id", 0.6)


@query("l07_one_vs_rest")
def one_vs_rest(t: Tables):
    return test_scores(t, cl.one_vs_rest(), embedding_rows(t), "vec_id", 0.8)


@query(
    "l08_naive_bayes",
    """WITH rows AS (SELECT l_returnflag AS c, unnest([0, 1, 2]) AS slot,
           unnest([l_quantity, CAST(l_linenumber AS DOUBLE), round(l_discount * 100)]) AS x FROM lineitem),
       classes AS (SELECT l_returnflag AS c, count(*) AS n,
           CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS INTEGER) AS class FROM lineitem GROUP BY 1),
       sums AS (SELECT c, slot, sum(x) AS s FROM rows GROUP BY ALL)
       SELECT class, slot, round(ln(n + 1) - ln((SELECT sum(n) FROM classes) + (SELECT count(*) FROM classes)), 9) AS pi,
         round(ln(s + 1) - ln(sum(s) OVER (PARTITION BY c) + 3), 9) AS theta
       FROM sums JOIN classes USING (c)""",
)
def naive_bayes(t: Tables):
    rows = t.lineitem.select(
        "l_returnflag", "l_quantity", "l_linenumber", F.round(F.col("l_discount") * 100).alias("d")
    )
    coded = ft.index_strings(rows).withColumnRenamed("l_returnflag", "label")
    vectors = ft.assemble(coded, ["l_quantity", "l_linenumber", "d"])
    table = cl.naive_bayes_tables(cl.naive_bayes().fit(vectors))
    df = t.spark.createDataFrame(table, "class int, slot int, pi double, theta double")
    return df.withColumns({c: F.round(c, 9) for c in ["pi", "theta"]})


@query("l08_naive_bayes_scores")
def naive_bayes_scores(t: Tables):
    return test_scores(t, cl.naive_bayes(), flag_rows(t), "l_orderkey", 0.7)


@query("l09_linear_svm")
def linear_svm(t: Tables):
    rows = flag_rows(t)
    train, test = sampling.hash_split(rows, "l_orderkey", 0.6)
    scored = cl.linear_svm(100).fit(train).transform(test)
    raw = scored.select("label", vector_to_array("rawPrediction")[1].alias("score"))
    return evaluation.area_under_roc(raw, "label", "score")


@query("l09_linear_svm_l1")
def sparse_svm(t: Tables):
    rows = ft.scale_maxabs(flag_rows(t), "features").select(
        "l_orderkey", "label", F.col("scaled").alias("features")
    )
    train, test = sampling.hash_split(rows, "l_orderkey", 0.6)
    scored = cl.linear_scores(test, cl.sparse_svm(train, 100, 0.001), 0.0)
    return evaluation.area_under_roc(scored.select("label", "score"), "label", "score")


@query("l10_multiclass_logistic_lbfgs")
def multinomial(t: Tables):
    return test_scores(t, cl.multinomial_logistic(), embedding_rows(t), "vec_id", 0.6)


@query("l11_score_new_events")
def score_new_events(t: Tables):
    """Chance that an event is a purchase, with facts about its user joined in."""
    customers = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    joined = t.events.join(customers, F.col("user_id") == F.col("c_custkey")).select(
        "event_id", (F.col("event_type") == "purchase").cast("double").alias("label"),
        "value", "c_nationkey", "c_acctbal",
    )
    rows = ft.assemble(joined, ["value", "c_nationkey", "c_acctbal"])
    known, new = sampling.hash_split(rows, "event_id", 0.8)
    model = cl.boosted_trees(5, 4).fit(known)
    return cl.score_rows(model, new).select("event_id", "p", "flagged")


# --- regression -------------------------------------------------------------

QUANTITY_TO_PRICE = ("l_quantity", "l_extendedprice")


def quantity_rows(t: Tables):
    rows = t.lineitem.select("l_quantity", F.col("l_extendedprice").alias("label"))
    return ft.assemble(rows, ["l_quantity"])


@query(
    "m01_linear_regression",
    """SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 6) AS coefficient FROM lineitem
       UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 6) FROM lineitem""",
)
def linear_regression(t: Tables):
    rows = quantity_rows(t)
    table = rg.coefficient_table(rg.least_squares(rows), ["l_quantity"], rows)
    return table.withColumn("coefficient", F.round("coefficient", 6))


@query("m01_linear_regression_elastic")
def elastic_net(t: Tables):
    model = rg.linear(price_rows(t), reg=0.3, elastic=0.8, max_iter=10)
    rows = [("rmse", model.summary.rootMeanSquaredError), ("r2", model.summary.r2)]
    return t.spark.createDataFrame(rows, "metric string, value double")


@query(
    "m02_sgd_least_squares",
    """SELECT round(avg(power(l_extendedprice - (i + s * l_quantity), 2)), 2) AS mse FROM lineitem,
         (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)""",
)
def least_squares_error(t: Tables):
    rows = quantity_rows(t)
    errors = evaluation.regression_errors(rg.least_squares(rows).transform(rows))
    return errors.select(F.round("mse", 2).alias("mse"))


@query("m03_lasso")
def lasso(t: Tables):
    rows = price_rows(t)
    model = rg.lasso(rows, 0.01)
    return rg.coefficient_table(model, ["quantity", "price", "discount", "line"], rows)


@query(
    "m04_glm",
    """SELECT round(s, 6) AS slope, round(i, 6) AS intercept,
         round(sum(power(l_extendedprice - (i + s * l_quantity), 2)) / 1e9, 4) AS deviance_e9 FROM lineitem,
         (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
       GROUP BY s, i""",
)
def glm(t: Tables):
    model = rg.generalized(quantity_rows(t), reg=0.0)
    row = (
        round(float(model.coefficients[0]), 6),
        round(float(model.intercept), 6),
        round(model.summary.deviance / 1e9, 4),
    )
    return t.spark.createDataFrame([row], "slope double, intercept double, deviance_e9 double")


@query("m04_glm_ridge")
def glm_ridge(t: Tables):
    summary_ = rg.generalized(price_rows(t), reg=0.3).summary
    rows = [
        ("deviance", float(summary_.deviance)),
        ("null_deviance", float(summary_.nullDeviance)),
        ("aic", float(summary_.aic)),
        ("dispersion", float(summary_.dispersion)),
    ]
    return t.spark.createDataFrame(rows, "metric string, value double")


@query("m04_glm_errors")
def glm_errors(t: Tables):
    """Standard error, t and p of every term; they exist without a penalty."""
    found = rg.generalized(price_rows(t), reg=0.0).summary
    names = ["quantity", "price", "discount", "line", "intercept"]
    rows = [
        (n, float(e), float(tv), float(p))
        for n, e, tv, p in zip(names, found.coefficientStandardErrors, found.tValues, found.pValues)
    ]
    return t.spark.createDataFrame(rows, "term string, error double, t double, p double")


@query("m05_decision_tree_regressor")
def decision_tree_regressor(t: Tables):
    return test_errors(rg.decision_tree(100, 100), price_rows(t), "l_orderkey", 0.7)


@query("m06_random_forest_regressor")
def random_forest_regressor(t: Tables):
    return test_errors(rg.random_forest(), price_rows(t), "l_orderkey", 0.7)


@query("m07_gbt_regressor")
def gbt_regressor(t: Tables):
    return test_errors(rg.boosted_trees(10), price_rows(t), "l_orderkey", 0.7)


@query("m08_aft_survival")
def aft_survival(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    lines = t.lineitem.select("l_orderkey", "l_shipdate", "l_quantity", "l_linestatus")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.date_diff(F.col("l_shipdate"), F.col("o_orderdate"))
    rows = joined.select(
        # Survival times are positive; a shipment dated before its order counts by the length of the gap.
        (F.abs(days) + 1).cast("double").alias("label"),
        F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0).alias("censor"),
        (F.col("l_quantity") / 50).alias("quantity"),
        (F.col("o_totalprice") / 500000).alias("price"),
    )
    model = rg.survival(ft.assemble(rows, ["quantity", "price"]))
    return t.spark.createDataFrame(
        [
            ("quantity", float(model.coefficients[0])),
            ("price", float(model.coefficients[1])),
            ("intercept", float(model.intercept)),
            ("scale", float(model.scale)),
        ],
        "term string, value double",
    )


@query(
    "m09_isotonic",
    """WITH levels AS (SELECT l_quantity AS x, avg(l_extendedprice) AS y, count(*) AS w FROM lineitem GROUP BY 1),
       spans AS (SELECT a.x AS a, b.x AS b, sum(c.y * c.w) / sum(c.w) AS m
         FROM levels a JOIN levels b ON a.x <= b.x JOIN levels c ON c.x BETWEEN a.x AND b.x GROUP BY ALL),
       lows AS (SELECT x, a, min(m) AS low FROM levels JOIN spans ON a <= x AND b >= x GROUP BY ALL)
       SELECT x AS quantity, round(max(low), 4) AS prediction FROM lows GROUP BY x""",
)
def isotonic(t: Tables):
    steps = rg.isotonic(t.lineitem, "l_quantity", "l_extendedprice")
    levels = t.lineitem.select(F.col("l_quantity").alias("quantity")).distinct()
    return rg.isotonic_predictions(steps, levels, "quantity").withColumn("prediction", F.round("prediction", 4))


@query(
    "m09_isotonic_distinct",
    """WITH levels AS (SELECT c_acctbal AS x, avg(c_nationkey) AS y, count(*) AS w FROM customer GROUP BY 1),
       sums AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(y * w) OVER (ORDER BY x) AS s, sum(w) OVER (ORDER BY x) AS w FROM levels),
       spans AS (SELECT a.i AS a, b.i AS b, (b.s - coalesce(p.s, 0)) / (b.w - coalesce(p.w, 0)) AS m
         FROM sums a JOIN sums b ON a.i <= b.i LEFT JOIN sums p ON p.i = a.i - 1),
       lows AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM spans)
       SELECT x AS balance, round(max(low), 6) AS prediction FROM lows JOIN sums ON i = b GROUP BY x""",
)
def isotonic_distinct(t: Tables):
    """Nearly as many values as rows, pooled in stretches that meet half way."""
    steps = rg.isotonic(t.customer, "c_acctbal", "c_nationkey", at_once=256)
    levels = t.customer.select(F.col("c_acctbal").alias("balance")).distinct()
    return rg.isotonic_predictions(steps, levels, "balance").withColumn("prediction", F.round("prediction", 6))


LINES_SQL = " UNION ALL ".join(
    f"""SELECT '{x}' AS x, '{y}' AS y, round(regr_slope({y}, {x}), 6) AS slope,
        round(regr_intercept({y}, {x}), 4) AS intercept FROM lineitem"""
    for x, y in [QUANTITY_TO_PRICE, ("l_discount", "l_extendedprice"), ("l_tax", "l_quantity")]
)


@query("m10_ols_lines", LINES_SQL)
def ols_lines(t: Tables):
    pairs = [QUANTITY_TO_PRICE, ("l_discount", "l_extendedprice"), ("l_tax", "l_quantity")]
    lines = summary.fit_lines(t.lineitem, pairs)
    return lines.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 4)})


@query(
    "m10_ols_plane",
    """WITH s AS (SELECT var_samp(l_quantity) AS s11, var_samp(l_tax) AS s22, covar_samp(l_quantity, l_tax) AS s12,
           covar_samp(l_quantity, l_extendedprice) AS s1y, covar_samp(l_tax, l_extendedprice) AS s2y,
           avg(l_quantity) AS m1, avg(l_tax) AS m2, avg(l_extendedprice) AS my FROM lineitem),
       b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
           (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s)
       SELECT round(my - b1 * m1 - b2 * m2, 4) AS intercept, round(b1, 4) AS b1, round(b2, 3) AS b2 FROM b""",
)
def ols_plane(t: Tables):
    plane = summary.fit_plane(t.lineitem, "l_extendedprice", "l_quantity", "l_tax")
    return plane.select(
        F.round("intercept", 4).alias("intercept"), F.round("b1", 4).alias("b1"), F.round("b2", 3).alias("b2")
    )


# --- clusters, factors, patterns --------------------------------------------


@query("p01_kmeans")
def kmeans(t: Tables):
    rows = embedding_rows(t)
    costs = [(k, float(clustering.kmeans(rows, k).summary.trainingCost)) for k in (2, 4, 8)]
    return t.spark.createDataFrame(costs, "k int, cost double")


@query("p01_kmeans_predict")
def kmeans_predict(t: Tables):
    rows = embedding_rows(t)
    return clustering.kmeans(rows, 2).transform(rows).select("vec_id", "prediction")


@query("p02_bisecting_kmeans")
def bisecting(t: Tables):
    rows = embedding_rows(t)
    model = clustering.bisecting_kmeans(rows, 2)
    return model.transform(rows).groupBy("prediction").agg(F.count("*").alias("n"))


@query("p03_gaussian_mixture")
def mixture(t: Tables):
    rows = ft.assemble(t.events, ["value", "user_id"]).select("features")
    model = clustering.gaussian_mixture(rows, 2)
    return clustering.components(model)


@query("p01_kmeans_centres")
def kmeans_centres(t: Tables):
    return clustering.centres(clustering.kmeans(embedding_rows(t), 8))


def far_groups(t: Tables):
    """Quantities of open and of closed lines, a thousand apart."""
    apart = F.when(F.col("l_linestatus") == "F", 1000.0).otherwise(0.0)
    rows = t.lineitem.select((F.col("l_quantity") + apart).alias("quantity"), F.col("l_tax").alias("tax"))
    return ft.assemble(rows, ["quantity", "tax"]).select("features")


FAR_GROUPS_SQL = """SELECT round(avg(l_quantity + CASE l_linestatus WHEN 'F' THEN 1000 ELSE 0 END), 5) AS quantity,
  round(avg(l_tax), 7) AS tax, count(*) AS n FROM lineitem GROUP BY CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END"""


def sized_centres(model, rows):
    sizes = model.transform(rows).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))
    return clustering.centres(model).join(sizes, "cluster").select(
        F.round(F.col("centre")[0], 5).alias("quantity"), F.round(F.col("centre")[1], 7).alias("tax"), "n"
    )


@query("p01_kmeans_groups", FAR_GROUPS_SQL)
def kmeans_groups(t: Tables):
    """Groups far apart are the clusters; centres are their means."""
    rows = far_groups(t)
    return sized_centres(clustering.kmeans(rows, 2), rows)


@query("p02_bisecting_groups", FAR_GROUPS_SQL)
def bisecting_groups(t: Tables):
    rows = far_groups(t)
    return sized_centres(clustering.bisecting_kmeans(rows, 2), rows)


def title_terms(t: Tables):
    """The words of every document, counted; words of at least four documents."""
    tokens = text.title_token_rows(t.documents, "doc_id", "text").select("doc_id", F.array("token").alias("tokens"))
    with recorded() as read, shuffles_removed(t.spark):
        counted = topics.term_counts(tokens, "doc_id", "tokens", 4.0)
        kept = list(read)
        counted = cut_lineage(counted, "title-terms")
    for path in kept:
        remove(t.spark, path)
    return counted


@query("p04_lda")
def lda(t: Tables):
    return topics.fit_topics(title_terms(t), 10).top_terms(3)


@query("p04_lda_fit")
def lda_fit(t: Tables):
    """Likelihood and perplexity of the topic model over its documents."""
    counts = title_terms(t)
    return topics.fit_topics(counts, 10).log_likelihood(counts)


@query("p04_lda_documents")
def lda_documents(t: Tables):
    """Mix of topics of every document."""
    counts = title_terms(t)
    return topics.fit_topics(counts, 10).documents(counts).withColumnRenamed("doc", "doc_id")


@query(
    "p04_lda_one_topic",
    f"""WITH w AS (SELECT doc_id, token AS term FROM ({TITLE_TOKENS_SQL})),
          k AS (SELECT term FROM w GROUP BY term HAVING count(DISTINCT doc_id) >= 4),
          c AS (SELECT term, count(*) AS n FROM w WHERE term IN (SELECT term FROM k) GROUP BY term)
        SELECT term, round((n + 1.0) / (SELECT sum(n + 1.0) FROM c), 12) AS weight FROM c""",
)
def lda_one_topic(t: Tables):
    """A single topic has a closed form: the smoothed share of each term."""
    model = topics.fit_topics(title_terms(t), 1, steps=2)
    whole = float(model.totals()[0])
    return model.terms.select("term", F.round(F.col("weights")[0] / whole, 12).alias("weight"))


def brand_ratings(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    orders = t.orders.select("o_orderkey", F.col("o_custkey").cast("int").alias("user"))
    parts = t.part.select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("item"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    return joined.groupBy("user", "item").agg(F.sum("l_quantity").cast("float").alias("rating"))


@query("p05_als")
def als(t: Tables):
    rated = brand_ratings(t).withColumn("id", F.col("user") * 100 + F.col("item"))
    train, test = sampling.hash_split(rated, "id", 0.8)
    model = clustering.recommender(train)
    return evaluation.regression_errors(model.transform(test), "rating", "prediction")


@query("p06_svd")
def svd(t: Tables):
    values, right = spectral.singular_values(t.embeddings, "embedding", 64, 5)
    rows = [(i, float(s)) for i, s in enumerate(values)]
    return t.spark.createDataFrame(rows, "place int, singular_value double")


@query(
    "p06_svd_pair",
    """WITH s AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_tax) AS b, sum(l_tax * l_tax) AS c FROM lineitem),
       e AS (SELECT (a + c) / 2 AS mid, sqrt(power((a - c) / 2, 2) + b * b) AS half, a * c - b * b AS det FROM s)
       SELECT 0 AS place, round(sqrt(mid + half), 3) AS singular_value FROM e
       UNION ALL SELECT 1, round(sqrt(det / (mid + half)), 3) FROM e""",
)
def svd_pair(t: Tables):
    """Two columns have a closed form."""
    pairs = t.lineitem.select(F.array(F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")).alias("v"))
    values, _ = spectral.singular_values(pairs, "v", 2, 2)
    df = t.spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "place int, singular_value double")
    return df.withColumn("singular_value", F.round("singular_value", 3))


@query("p06_svd_left")
def svd_left(t: Tables):
    values, right = spectral.singular_values(t.embeddings, "embedding", 64, 5)
    left = clustering.left_vectors(t.embeddings, "embedding", values, right)
    slots = left.select("vec_id", F.posexplode("u").alias("pos", "value"))
    return slots.withColumn("value", F.round(F.abs("value"), 6))


def brand_baskets(t: Tables, support: float):
    lines = t.lineitem.select("l_orderkey", "l_partkey")
    parts = t.part.select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return patterns.baskets(joined, "l_orderkey", "p_brand", support)


# Every subset of every basket, counted; items of a set are in order.
ITEMSETS_SQL = """WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS o, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
  subsets AS (SELECT o, i AS last, i AS items, 1 AS size FROM b
    UNION ALL SELECT s.o, b.i, s.items || ' ' || b.i, s.size + 1 FROM subsets s JOIN b ON s.o = b.o AND b.i > s.last),
  itemsets AS (SELECT items, size, count(*) AS freq FROM subsets GROUP BY ALL
    HAVING count(*) >= ceil({support} * (SELECT count(DISTINCT o) FROM b)))"""


@query(
    "p07_fp_growth",
    f"{ITEMSETS_SQL.format(support=0.001)} SELECT items, freq FROM itemsets",
)
def fp_growth(t: Tables):
    model = patterns.frequent_itemsets(brand_baskets(t, 0.001), 0.001)
    return model.freqItemsets.select(F.array_join(F.array_sort("items"), " ").alias("items"), "freq")


@query(
    "p08_association_rules",
    f"""{ITEMSETS_SQL.format(support=0.01)},
        rules AS (SELECT items, freq, unnest(string_split(items, ' ')) AS consequent FROM itemsets WHERE size > 1),
        split AS (SELECT *, array_to_string(list_filter(string_split(items, ' '), lambda x: x <> consequent), ' ')
          AS antecedent FROM rules)
        SELECT antecedent, consequent, split.freq, round(split.freq / part.freq, 9) AS confidence
        FROM split JOIN itemsets part ON part.items = antecedent WHERE split.freq / part.freq >= 0.12""",
)
def rules(t: Tables):
    itemsets = patterns.frequent_itemsets(brand_baskets(t, 0.01), 0.01).freqItemsets
    found = patterns.association_rules(itemsets, 0.12)
    return found.select(
        F.array_join("antecedent", " ").alias("antecedent"),
        "consequent",
        "freq",
        F.round("confidence", 9).alias("confidence"),
    )


def priority_sequences(t: Tables, length: int):
    """Frequent runs of order priorities of a customer."""
    found = patterns.mine_sequences(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority", 0.2, length)
    return found.select(F.array_join("sequence", " > ").alias("sequence"), "freq")


@query(
    "p09_prefix_span",
    """WITH RECURSIVE s AS (SELECT o_custkey AS c, o_orderpriority AS p,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
       step AS (SELECT a.c, a.rn, b.p, min(b.rn) AS nrn FROM (SELECT c, rn FROM s UNION SELECT c, 0 FROM s) a
         JOIN s b ON a.c = b.c AND b.rn > a.rn GROUP BY ALL),
       found AS (SELECT c, p AS sequence, nrn AS rn, 1 AS size FROM step WHERE rn = 0
         UNION ALL SELECT f.c, f.sequence || ' > ' || step.p, step.nrn, f.size + 1
         FROM found f JOIN step ON f.c = step.c AND f.rn = step.rn WHERE f.size < 5)
       SELECT sequence, count(*) AS freq FROM found GROUP BY 1
       HAVING count(*) >= ceil(0.2 * (SELECT count(DISTINCT c) FROM s))""",
)
def prefix_span(t: Tables):
    return priority_sequences(t, 5)


@query(
    "p09_prefix_span_single",
    """SELECT o_orderpriority AS sequence, count(DISTINCT o_custkey) AS freq FROM orders GROUP BY 1
       HAVING count(DISTINCT o_custkey) >= ceil(0.2 * (SELECT count(DISTINCT o_custkey) FROM orders))""",
)
def prefix_span_single(t: Tables):
    return priority_sequences(t, 1)


@query(
    "p09_prefix_span_pairs",
    """WITH s AS (SELECT o_custkey AS c, o_orderpriority AS p,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
       least AS (SELECT ceil(0.2 * count(DISTINCT c)) AS n FROM s)
       SELECT p AS sequence, count(DISTINCT c) AS freq FROM s GROUP BY 1 HAVING count(DISTINCT c) >= (SELECT n FROM least)
       UNION ALL SELECT x.p || ' > ' || y.p, count(DISTINCT x.c) FROM s x JOIN s y ON x.c = y.c AND x.rn < y.rn
       GROUP BY 1 HAVING count(DISTINCT x.c) >= (SELECT n FROM least)""",
)
def prefix_span_pairs(t: Tables):
    return priority_sequences(t, 2)
