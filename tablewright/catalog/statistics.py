"""Queries of group N: statistics and evaluation."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablewright.analysis import evaluation, hypothesis, sampling, summary
from tablewright.catalog.registry import Tables, query
from tablewright.functions import features as ft
from tablewright.learning import classification


def summary_sql(table: str, values: dict[str, str], digits: int = 4) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", round(avg({v}), {digits}) AS mean,
            round(var_samp({v}), {digits}) AS variance, count(*) FILTER (WHERE {v} <> 0) AS nonzero FROM {table}"""
        for name, v in values.items()
    )


def rounded(df, digits: int = 4):
    return df.withColumns({c: F.round(c, digits) for c in ["mean", "variance"]})


@query(
    "n01_column_summary",
    summary_sql("lineitem", {c: c for c in ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]}, 3),
)
def column_summary(t: Tables):
    columns = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    return rounded(summary.column_summary(t.lineitem, columns), 3)


@query(
    "n02_table_summary",
    summary_sql(
        "customer",
        {
            "c_custkey": "CAST(c_custkey AS DOUBLE)",
            "c_name": "0.0::DOUBLE",
            "c_nationkey": "coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END, 0.0)",
            "c_acctbal": "c_acctbal",
            "c_mktsegment": "0.0::DOUBLE",
        },
    ),
)
def table_summary(t: Tables):
    nation = F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey"))
    return rounded(summary.table_summary(t.customer.withColumn("c_nationkey", nation)))


@query(
    "n03_correlation_pair",
    "SELECT round(corr(l_quantity, l_extendedprice), 8) AS correlation FROM lineitem",
)
def correlation_pair(t: Tables):
    pair = summary.correlation_pair(t.lineitem, "l_quantity", "l_extendedprice")
    return pair.select(F.round("correlation", 8).alias("correlation"))


@query(
    "n03_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS correlation FROM part"
        for a, b in [
            ("p_partkey", "p_partkey"), ("p_partkey", "p_size"), ("p_partkey", "p_retailprice"),
            ("p_size", "p_size"), ("p_size", "p_retailprice"), ("p_retailprice", "p_retailprice"),
        ]
    ),
)
def correlation_matrix(t: Tables):
    matrix = summary.correlation_matrix(t.part, ["p_partkey", "p_size", "p_retailprice"])
    return matrix.withColumn("correlation", F.round("correlation", 6))


@query(
    "n03_correlation_spearman",
    """WITH r AS (SELECT l_quantity, l_extendedprice,
           rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx,
           rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ry
         FROM lineitem)
       SELECT round(corr(rx, ry), 8) AS correlation FROM r""",
)
def correlation_spearman(t: Tables):
    ranks = summary.spearman(t.lineitem, "l_quantity", "l_extendedprice")
    return ranks.select(F.round("correlation", 8).alias("correlation"))


@query(
    "n04_chisq_independence",
    """WITH cells AS (SELECT l_linenumber AS f, l_returnflag AS l, count(*) AS o FROM lineitem GROUP BY ALL),
       full_cells AS (SELECT r.f, c.l, coalesce(o, 0) AS o, r.n * c.n / (SELECT count(*) FROM lineitem) AS e
         FROM (SELECT f, sum(o) AS n FROM cells GROUP BY f) r, (SELECT l, sum(o) AS n FROM cells GROUP BY l) c
         LEFT JOIN cells ON cells.f = r.f AND cells.l = c.l)
       SELECT round(sum((o - e) * (o - e) / e), 6) AS statistic,
         (count(DISTINCT f) - 1) * (count(DISTINCT l) - 1) AS df FROM full_cells""",
)
def chi_square(t: Tables):
    test = hypothesis.chi_square_independence(t.lineitem, "l_linenumber", "l_returnflag")
    return test.withColumn("statistic", F.round("statistic", 6))


@query("n04_chisq_features_test")
def chi_square_features(t: Tables):
    rows = t.lineitem.select("l_returnflag", "l_linenumber", F.round(F.col("l_tax") * 100).alias("tax"))
    vectors = ft.assemble(ft.index_strings(rows), ["l_linenumber", "tax"])
    return hypothesis.chi_square_test(vectors, "features", "l_returnflag")


@query(
    "n05_chisq_goodness",
    """SELECT round(sum((o - e) * (o - e) / e), 6) AS statistic, count(*) - 1 AS df FROM (
         SELECT count(*) AS o, (SELECT count(*) FROM events) / (SELECT count(DISTINCT event_type) FROM events) AS e
         FROM events GROUP BY event_type)""",
)
def goodness(t: Tables):
    test = hypothesis.chi_square_goodness(t.events, "event_type")
    return test.withColumn("statistic", F.round("statistic", 6))


@query(
    "n05_chisq_goodness_given",
    """SELECT round(sum((o - e) * (o - e) / e), 6) AS statistic, count(*) - 1 AS df FROM (
         SELECT o.n AS o, c.n * (SELECT count(*) FROM orders) / (SELECT count(*) FROM customer) AS e
         FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c
         JOIN (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o
           ON o.k = c.k)""",
)
def goodness_given(t: Tables):
    expected = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("weight"))
    keys = t.customer.select("c_custkey", "c_nationkey")
    observed = t.orders.select("o_custkey").join(keys, F.col("o_custkey") == F.col("c_custkey"))
    test = hypothesis.chi_square_goodness(observed, "c_nationkey", expected)
    return test.withColumn("statistic", F.round("statistic", 6))


@query("n06_ks_test")
def ks_normal(t: Tables):
    moments = t.customer.agg(F.avg("c_acctbal").alias("m"), F.stddev("c_acctbal").alias("s")).first()
    return hypothesis.ks_normal(t.customer, "c_acctbal", moments["m"], moments["s"])


@query(
    "n06_ks_statistic",
    """WITH z AS (SELECT c_acctbal AS v, (c_acctbal - m) / s AS z FROM customer,
         (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)),
       steps AS (SELECT v, any_value(z) AS z, count(*) AS n, sum(count(*)) OVER (ORDER BY v) AS upto FROM z GROUP BY v),
       p AS (SELECT *, 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60),
           lambda i: power(z, 2 * i + 1) / exp(lgamma(2 * i + 2) - i * ln(2) - lgamma(i + 1)))) AS p FROM steps)
       SELECT round(max(greatest(upto / total - p, p - (upto - n) / total)), 9) AS statistic
       FROM p, (SELECT count(*) AS total FROM customer)""",
)
def ks_normal_statistic(t: Tables):
    return ks_normal(t).select(F.round("statistic", 9).alias("statistic"))


@query(
    "n07_ks_custom_cdf",
    """WITH counts AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1),
       steps AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS upto, (SELECT count(*) FROM lineitem) AS total FROM counts),
       cdf AS (SELECT CAST(p_size AS DOUBLE) AS v, p_size / 50 AS p FROM part GROUP BY p_size)
       SELECT round(max(greatest(upto / total - p, p - (upto - n) / total)), 9) AS statistic
       FROM steps JOIN cdf USING (v)""",
)
def ks_custom(t: Tables):
    cdf = t.part.select(
        F.col("p_size").cast("double").alias("value"), (F.col("p_size") / 50).alias("probability")
    ).distinct()
    statistic = hypothesis.ks_custom(t.lineitem, "l_quantity", cdf)
    return statistic.select(F.round("statistic", 9).alias("statistic"))


FRACTIONS = {"click": 0.1, "error": 0.6, "purchase": 0.3}


@query("n08_stratified_sample")
def stratified(t: Tables):
    sample = sampling.sample_strata(t.events, "event_type", FRACTIONS, seed=8)
    return sample.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "n08_stratified_sample_exact",
    """SELECT event_id, event_type FROM (
         SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n,
           row_number() OVER (PARTITION BY event_type
             ORDER BY (event_id % 2147483648 * 1103515245 + 12345) % 2147483648, event_id) AS rn,
           CASE event_type WHEN 'click' THEN 0.1 WHEN 'error' THEN 0.6 WHEN 'purchase' THEN 0.3 END AS fraction
         FROM events) WHERE rn <= ceil(CAST(fraction AS DOUBLE) * n)""",
)
def stratified_exact(t: Tables):
    rows = t.events.select("event_id", "event_type")
    return sampling.sample_strata_exact(rows, "event_type", FRACTIONS, "event_id")


@query(
    "n09_kernel_density",
    """SELECT CAST(p AS DOUBLE) AS point, round(avg(exp(-power((value - p) / 3, 2) / 2)) / (3 * sqrt(2 * pi())), 9)
         AS density FROM events, (SELECT unnest([1.0, 10.0, 50.0, 200.0]) AS p) GROUP BY p""",
)
def density(t: Tables):
    densities = summary.kernel_density(t.events, "value", [1.0, 10.0, 50.0, 200.0], 3.0)
    return densities.withColumn("density", F.round("density", 9))


@query(
    "n10_train_test_split",
    """SELECT o_orderkey, CASE WHEN (o_orderkey % 2147483648 * 1103515245 + 12345) % 2147483648
         < CAST(floor(0.7 * 2147483648) AS BIGINT) THEN 'train' ELSE 'test' END AS side FROM orders""",
)
def split(t: Tables):
    train, test = sampling.hash_split(t.orders.select("o_orderkey"), "o_orderkey", 0.7)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("n10_random_split")
def random_split(t: Tables):
    parts = sampling.random_split(t.orders.select("o_orderkey"), [0.6, 0.4], seed=10)
    sides = [p.agg(F.count("*").alias("n")).withColumn("side", F.lit(i)) for i, p in enumerate(parts)]
    return sides[0].unionByName(sides[1])


@query("n11_cross_validation")
def cross_validation(t: Tables):
    rows = t.documents.join(t.labels, "doc_id").select(
        "doc_id", "text", F.col("quality").cast("double").alias("label")
    )
    scores, best = classification.cross_validate_text(rows, "text", seed=11)
    return scores


@query(
    "n12_eval_rmse_mse",
    """SELECT round(avg(power(l_extendedprice - l_quantity * 3000, 2)), 2) AS mse,
         round(sqrt(avg(power(l_extendedprice - l_quantity * 3000, 2))), 4) AS rmse FROM lineitem""",
)
def rmse(t: Tables):
    predicted = t.lineitem.select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 3000).alias("prediction")
    )
    errors = evaluation.regression_errors(predicted)
    return errors.select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"))


@query(
    "n13_eval_accuracy_precision",
    """WITH p AS (SELECT l_linestatus = 'F' AS label, l_returnflag <> 'N' AS prediction FROM lineitem),
       per_class AS (SELECT c, count(*) FILTER (WHERE label = c) AS labels,
           count(*) FILTER (WHERE prediction = c) AS predicted,
           count(*) FILTER (WHERE prediction = c AND label = c) AS hits
         FROM p, (SELECT unnest([true, false]) AS c) GROUP BY c)
       SELECT round(sum(hits) / sum(labels), 9) AS accuracy, round(1 - sum(hits) / sum(labels), 9) AS test_error,
         round(sum(hits / predicted * labels) / sum(labels), 9) AS weighted_precision FROM per_class""",
)
def accuracy(t: Tables):
    predicted = t.lineitem.select(
        (F.col("l_linestatus") == "F").alias("label"), (F.col("l_returnflag") != "N").alias("prediction")
    )
    scores = evaluation.classification_scores(predicted)
    return scores.select(*[F.round(c, 9).alias(c) for c in scores.columns])


@query(
    "n14_eval_auc",
    """WITH s AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r
         FROM documents JOIN labels USING (doc_id))
       SELECT round((sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) *
           (count(*) FILTER (WHERE quality = 1) + 1) / 2) /
         (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 9) AS auc FROM s""",
)
def auc(t: Tables):
    scored = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    area = evaluation.area_under_roc(scored, "quality", "n_chars")
    return area.select(F.round("auc", 9).alias("auc"))


@query(
    "n15_residuals",
    """SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice - (i + s * l_quantity), 4) AS residual
       FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS s,
         regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)""",
)
def residuals(t: Tables):
    rows = t.lineitem.withColumnRenamed("l_extendedprice", "label")
    vectors = ft.assemble(rows, ["l_quantity"])
    model = LinearRegression(solver="normal").fit(vectors)
    found = evaluation.residuals(model.transform(vectors))
    return found.select("l_orderkey", "l_partkey", "l_linenumber", F.round("residual", 4).alias("residual"))
