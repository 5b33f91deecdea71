"""Queries of groups B, E and F: projections, filters, order, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.analysis.summary import column_variances
from tablewright.catalog.registry import Tables, query
from tablewright.operators import columns, filters, ordering, request
from tablewright.operators.aggregates import union_header_rows
from tablewright.plans import transforms
from tablewright.plans.actions import apply_filters

CUSTOMER_WITH_NULLS = """SELECT c_custkey,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  c_mktsegment FROM customer"""


def customer_with_nulls(t: Tables):
    return t.customer.withColumns(
        {
            "c_name": F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")),
            "c_nationkey": F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")),
            "c_acctbal": F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")),
        }
    )


@query(
    "b01_request",
    """SELECT DISTINCT o_orderpriority, o_orderstatus, o_custkey FROM orders
       WHERE o_totalprice > 200000 ORDER BY o_custkey DESC, o_orderpriority, o_orderstatus LIMIT 500""",
)
def full_request(t: Tables):
    return request.apply_request(
        t.orders,
        filter="o_totalprice > 200000",
        select="o_orderpriority,o_orderstatus,o_custkey",
        distinct=True,
        order_by="o_custkey desc,o_orderpriority,o_orderstatus asc",
        limit=500,
    )


@query(
    "b01_request_count",
    """SELECT count(*) AS count FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem
       WHERE l_quantity > 20)""",
)
def counted_request(t: Tables):
    return request.apply_request(
        t.lineitem, filter="l_quantity > 20", select="l_partkey,l_suppkey", distinct=True, count=True
    )


PRIORITY_SQL = """SELECT o_orderpriority, count(*) AS n,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority HAVING count(*) > 10"""


@query("b02_sql_query", PRIORITY_SQL)
def sql_text(t: Tables):
    request.temp_view(t.orders, "orders")
    return request.run_sql(t.spark, PRIORITY_SQL)


@query("b03_filter_expr", "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name LIKE '%ring%'")
def expression_filter(t: Tables):
    return request.filter_expr(t.part, "p_size BETWEEN 10 AND 20 AND p_name LIKE '%ring%'")


@query("b04_select_columns", "SELECT l_orderkey, l_shipdate, l_tax FROM lineitem")
def column_list(t: Tables):
    return request.select_columns(t.lineitem, "l_orderkey, l_shipdate, l_tax")


@query(
    "b05_filter_not_null",
    f"SELECT * FROM ({CUSTOMER_WITH_NULLS}) WHERE c_name IS NOT NULL AND c_nationkey IS NOT NULL",
)
def not_null(t: Tables):
    return filters.filter_not_null(customer_with_nulls(t), ["c_name", "c_nationkey"])


@query(
    "b06_filter_not_equal_action",
    f"""SELECT * FROM ({CUSTOMER_WITH_NULLS})
        WHERE c_acctbal IS NOT NULL AND c_mktsegment <> 'HOUSEHOLD'""",
)
def not_equal_action(t: Tables):
    actions = [("c_acctbal", "filter", "null"), ("c_mktsegment", "filter", "HOUSEHOLD")]
    return apply_filters(customer_with_nulls(t), actions)


@query("b07_filter_threshold_sort", "SELECT * FROM part WHERE p_retailprice > 950 ORDER BY p_retailprice")
def threshold_sort(t: Tables):
    return filters.filter_threshold_sort(t.part, "p_retailprice", 950.0)


@query("b08_replace_column_constant", "SELECT r_regionkey, n.n_nationkey, n_name, 42 AS n_regionkey FROM nation n JOIN region ON n_regionkey = r_regionkey")
def constant_column(t: Tables):
    joined = t.nation.join(t.region.select("r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey"))
    return columns.replace_with_constant(joined, "n_regionkey", 42)


@query(
    "b09_conditional_log",
    """SELECT o_orderkey, o_totalprice > 0 AS positive, round(ln(o_totalprice), 6) AS o_totalprice,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 0.25::DOUBLE END AS rate,
         CASE WHEN o_orderkey % 1000 >= 500 THEN round(ln(o_orderkey % 1000 - 499.0), 6) END AS shifted
       FROM orders""",
)
def conditional_log(t: Tables):
    rows = t.orders.select(
        "o_orderkey",
        (F.col("o_totalprice") > 0).alias("positive"),
        "o_totalprice",
        F.when(F.col("o_orderkey") % 9 != 0, F.lit(0.25)).alias("rate"),
        (F.col("o_orderkey") % 1000 - 499).cast("double").alias("shifted"),
    )
    variances = column_variances(rows)
    logged = transforms.conditional_log(rows, ["o_totalprice", "rate", "shifted"], variances)
    return logged.withColumns({c: F.round(c, 6) for c in ["o_totalprice", "shifted"]})


@query(
    "b10_fill_nulls_by_type",
    f"""SELECT c_custkey, coalesce(c_name, '') AS c_name, coalesce(c_nationkey, 0) AS c_nationkey,
          coalesce(c_acctbal, 0.0) AS c_acctbal, c_mktsegment FROM ({CUSTOMER_WITH_NULLS})""",
)
def fill_nulls(t: Tables):
    df = customer_with_nulls(t)
    return transforms.fill_nulls_by_type(df, ["c_name", "c_nationkey", "c_acctbal"])


@query(
    "b11_filter_dimension",
    """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
       WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')""",
)
def dimension(t: Tables):
    keys = t.part.filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    return filters.filter_keys(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), keys, "l_partkey")


@query(
    "b11_filter_dimension_list",
    """SELECT l_orderkey, l_suppkey FROM lineitem
       WHERE l_suppkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 90, 91)""",
)
def dimension_list(t: Tables):
    keys = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 90, 91]
    return filters.filter_keys(t.lineitem, keys, "l_suppkey").select("l_orderkey", "l_suppkey")


@query(
    "b12_filter_dimension_pair",
    """SELECT * FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s JOIN nation ON s_nationkey = n_nationkey
         WHERE s_nationkey = c.c_nationkey AND c.c_mktsegment =
           CASE WHEN n_regionkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END)""",
)
def dimension_pair(t: Tables):
    segment = F.when(F.col("n_regionkey") % 2 == 0, "BUILDING").otherwise("MACHINERY")
    keys = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_nationkey").alias("c_nationkey"), segment.alias("c_mktsegment")
    )
    pair = ["c_nationkey", "c_mktsegment"]
    return filters.filter_keys(t.customer, keys, pair).select(*t.customer.columns)


@query(
    "b13_rename_replace",
    "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, length(p_type) AS p_type FROM part",
)
def rename_replace(t: Tables):
    return columns.replace_with(t.part, "p_type", F.length("p_type").cast("long"))


@query(
    "b14_sanitize_names",
    'SELECT n_nationkey AS "Community_Area_Number", n_name AS "AGED_25__WITHOUT", n_regionkey AS "region" FROM nation',
)
def clean_names(t: Tables):
    return columns.sanitize_names(t.nation.toDF("Community Area Number ", "AGED 25+ WITHOUT", " region"))


@query("b15_drop_by_position", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def by_position(t: Tables):
    return columns.drop_by_position(t.supplier, 1)


@query(
    "b16_destination_filter",
    f"SELECT * FROM ({CUSTOMER_WITH_NULLS}) WHERE c_nationkey IS NOT DISTINCT FROM NULL",
)
def optional_value(t: Tables):
    return filters.filter_optional_value(customer_with_nulls(t), "c_nationkey", None)


@query("b17_select_ml_columns", "SELECT l_returnflag, l_quantity, l_tax FROM lineitem")
def ml_columns(t: Tables):
    lists = columns.model_columns(
        t.lineitem.columns, ["l_returnflag", "absent"], ["l_tax", "l_returnflag", "l_quantity"]
    )
    chosen = lists["targets"] + lists["features"]
    return t.lineitem.select(*chosen)


@query("e01_order_by_spec", "SELECT * FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 100")
def order_spec(t: Tables):
    return request.order_by_spec(t.orders, "o_orderpriority desc,o_orderkey asc").limit(100)


@query("e02_limit", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 50")
def first_rows(t: Tables):
    return t.events.select("event_id", "ts", "value").orderBy("ts", "event_id").limit(50)


@query("e03_sort_all_columns", "SELECT * FROM supplier ORDER BY ALL")
def all_columns(t: Tables):
    return ordering.sort_all_columns(t.supplier)


@query(
    "e04_topk_by_weight",
    """SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight FROM lineitem
       GROUP BY l_partkey ORDER BY weight DESC, l_partkey LIMIT 10""",
)
def topk(t: Tables):
    weights = t.lineitem.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("weight"))
    return ordering.top_by_weight(weights, "weight", 10, ["l_partkey"])


@query("f01_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(t: Tables):
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


@query(
    "f02_union_header_rows",
    """SELECT 0 AS line_no, 'r_regionkey,r_name' AS line
       UNION ALL SELECT r_regionkey + 1, CAST(r_regionkey AS VARCHAR) || ',' || r_name FROM region""",
)
def header_rows(t: Tables):
    header = t.region.agg(F.lit(0).alias("line_no"), F.lit(",".join(t.region.columns)).alias("line"))
    numbered = t.region.withColumn("line_no", F.col("r_regionkey") + 1)
    lines = numbered.select(
        "line_no", F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name").alias("line")
    )
    return union_header_rows(header, lines).orderBy("line_no")
