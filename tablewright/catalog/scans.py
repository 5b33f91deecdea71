"""Queries of group A: sources and sinks.

The file readers are shown on a whole table that Spark first writes to the
shared folder in the format in question.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F, types as T

from tablewright.catalog.registry import Tables, query
from tablewright.operators.filters import lookup_in_list
from tablewright.operators.request import run_sql, temp_view
from tablewright.plans.actions import plan_matrix
from tablewright.sinks.files import csv_line, prediction_lines, write_csv, write_many, write_single_csv
from tablewright.sources import files, generated
from tablewright.sources.jdbc import fold_types
from tablewright.storage import scratch_path


def _lines(t: Tables, label: str, lines) -> str:
    path = scratch_path(t.spark, label)
    lines.write.text(path)
    return path


@query("a01_scan_csv_inferred", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_inferred(t: Tables):
    path = scratch_path(t.spark, "csv")
    t.nation.write.csv(path, header=True)
    return files.read_csv_inferred(t.spark, path, "nation")


@query("a02_scan_csv_schema", "SELECT r_regionkey, r_name FROM region")
def csv_schema(t: Tables):
    path = scratch_path(t.spark, "csv")
    t.region.write.csv(path)
    return files.read_csv_schema(t.spark, path, "r_regionkey int, r_name string")


@query(
    "a03_scan_csv_typed_header",
    """SELECT CAST(p_partkey AS VARCHAR) AS p_key, p_name, p_size, p_retailprice,
         CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size > 25 END AS large
       FROM part""",
)
def csv_typed_header(t: Tables):
    path = scratch_path(t.spark, "csv")
    large = F.when(F.col("p_size") % 7 != 0, F.col("p_size") > 25)
    rows = t.part.select(
        F.col("p_partkey").alias("p_key:string"),
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("p_name:string"),
        F.col("p_size").alias("p_size:integer"),
        F.col("p_retailprice").alias("p_retailprice:double"),
        large.alias("large:boolean"),
    )
    rows.write.csv(path, header=True, quote="")
    return files.read_csv_typed_header(t.spark, path)


@query(
    "a04_scan_text_split",
    """SELECT CAST(n_nationkey AS VARCHAR) AS nation_key, n_name AS name,
         CAST(n_regionkey AS VARCHAR) AS region_key, '' AS remark FROM nation""",
)
def text_split(t: Tables):
    lines = t.nation.select(F.concat_ws(" , ", "n_nationkey", "n_name", "n_regionkey", F.lit("")))
    path = _lines(t, "text", lines)
    return files.read_text_split(t.spark, path, ["nation_key", "name", "region_key", "remark"])


@query(
    "a05_scan_text_skip_header",
    "SELECT c_mktsegment AS category, c_name AS title FROM customer",
)
def text_skip_header(t: Tables):
    path = scratch_path(t.spark, "csv")
    rows = t.customer.select(F.col("c_mktsegment").alias("category"), F.col("c_name").alias("title"))
    rows.write.csv(path, header=True)
    return files.read_text_skip_header(t.spark, path, "category", ["category", "title"])


@query(
    "a06_scan_tsv_labelled",
    r"""SELECT CASE l.quality WHEN 1 THEN 'ham' ELSE 'spam' END AS label,
          regexp_replace(d.text, '\s+', ' ', 'g') AS text
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def tsv_labelled(t: Tables):
    joined = t.documents.join(t.labels, "doc_id", "left")
    label = F.when(F.col("quality") == 1, "ham").when(F.col("quality") == 0, "spam").otherwise("")
    text = F.regexp_replace("text", r"[ \t\n\f\r]+", " ")
    path = _lines(t, "tsv", joined.select(F.concat_ws("\t", label, text)))
    return files.read_labelled_tsv(t.spark, path)


@query(
    "a07_scan_text_reject_bad",
    """SELECT o_orderkey AS order_key, o_totalprice AS price FROM orders
       WHERE o_orderkey % 10 <> 3 AND o_orderkey % 10 <> 7""",
)
def text_reject_bad(t: Tables):
    price = F.when(F.col("o_orderkey") % 10 == 3, "n/a").otherwise(
        F.col("o_totalprice").cast("string")
    )
    line = F.when(F.col("o_orderkey") % 10 == 7, F.col("o_orderkey").cast("string")).otherwise(
        F.concat_ws(",", "o_orderkey", price)
    )
    path = _lines(t, "text", t.orders.select(line))
    schema = T.StructType().add("order_key", "long").add("price", "double")
    return files.read_csv_drop_bad(t.spark, path, schema)


@query(
    "a08_scan_ratings",
    """SELECT CAST(l_partkey AS INTEGER) AS "user", CAST(l_suppkey AS INTEGER) AS item,
         CAST(l_quantity AS FLOAT) AS rating, l_orderkey AS "timestamp"
       FROM lineitem WHERE l_linenumber <> 7""",
)
def ratings(t: Tables):
    four = F.concat_ws("::", "l_partkey", "l_suppkey", "l_quantity", "l_orderkey")
    line = F.when(F.col("l_linenumber") == 7, F.concat_ws("::", "l_partkey", "l_suppkey"))
    path = _lines(t, "ratings", t.lineitem.select(F.coalesce(line, four)))
    return files.read_ratings(t.spark, path)


@query(
    "a09_scan_libsvm",
    """SELECT CAST(p_partkey AS DOUBLE) AS label, pos, value FROM (
         SELECT p_partkey, unnest([0, 1, 2]) AS pos,
           unnest([CAST(p_size AS DOUBLE), p_retailprice, 0.0]) AS value FROM part)""",
)
def libsvm(t: Tables):
    path = scratch_path(t.spark, "libsvm")
    values = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(0.0))
    rows = t.part.select(
        F.col("p_partkey").cast("double").alias("label"), array_to_vector(values).alias("features")
    )
    rows.write.format("libsvm").save(path)
    read = files.read_libsvm(t.spark, path, 3)
    return read.select("label", F.posexplode(vector_to_array("features")).alias("pos", "value"))


@query(
    "a10_scan_labeled_point",
    """SELECT p_retailprice AS label, CAST(p_size AS DOUBLE) AS x1,
         CAST(p_partkey AS DOUBLE) AS x2 FROM part""",
)
def labeled_point(t: Tables):
    line = F.concat("p_retailprice", F.lit(","), F.concat_ws(" ", "p_size", "p_partkey"))
    read = files.read_labeled_points(t.spark, _lines(t, "points", t.part.select(line)))
    values = vector_to_array("features")
    return read.select("label", values[0].alias("x1"), values[1].alias("x2"))


@query(
    "a11_scan_vector_text",
    """SELECT CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS DOUBLE) END AS label,
         CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2 FROM part""",
)
def vector_text(t: Tables):
    inner = F.concat_ws(",", "p_size", "p_retailprice")
    line = (
        F.when(F.col("p_size") % 3 == 0, F.format_string("(%s, [%s])", "p_partkey", inner))
        .when(F.col("p_size") % 3 == 1, F.format_string("[%s]", inner))
        .otherwise(F.concat_ws(" ", "p_size", "p_retailprice"))
    )
    read = files.read_vector_text(t.spark, _lines(t, "vectors", t.part.select(line)))
    return read.select("label", F.col("values")[0].alias("x1"), F.col("values")[1].alias("x2"))


@query(
    "a12_scan_parquet",
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'",
)
def parquet(t: Tables):
    rows = files.read_parquet(t.spark, f"{t.folder}/lineitem.parquet")
    recent = rows.filter(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return recent.select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "a14_scan_jdbc_partitioned",
    """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 2))::DOUBLE AS price,
         CAST(o_custkey % 100 AS INTEGER) AS small,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders""",
)
def folded(t: Tables):
    rows = t.orders.select(
        F.col("o_orderkey").alias("O_ORDERKEY"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("PRICE"),
        (F.col("o_custkey") % 100).cast("smallint").alias("SMALL"),
        F.col("o_orderdate").alias("O_ORDERDATE"),
    )
    return fold_types(rows)


@query(
    "a15_lookup_in_list",
    "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 3, 5, 7)",
)
def lookup(t: Tables):
    return lookup_in_list(t.supplier, "s_nationkey", [1, 3, 5, 7], "s_suppkey")


@query(
    "a16_rows_to_table",
    """SELECT b.name, count(*) AS n FROM lineitem
       JOIN (VALUES (1, 'low'), (2, 'middle'), (3, 'high')) b(level, name)
         ON b.level = 1 + (l_linenumber - 1) // 3
       GROUP BY b.name""",
)
def literal_rows(t: Tables):
    names = generated.rows_to_table(
        t.spark, [(1, "low"), (2, "middle"), (3, "high")], "level int, name string"
    )
    level = 1 + F.floor((F.col("l_linenumber") - 1) / 3).cast("int")
    rows = t.lineitem.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    return rows.join(names, "level").select("name", "n")


@query("a17_random_normal_table")
def random_normals(t: Tables):
    n = t.lineitem.count()
    draws = generated.random_normals(t.spark, n, 10, seed=17)
    return draws.agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("deviation")
    )


@query(
    "a18_temp_view",
    """SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
       FROM orders GROUP BY o_orderstatus""",
)
def view(t: Tables):
    temp_view(t.orders, "tablewright_orders")
    return run_sql(
        t.spark,
        """SELECT o_orderstatus,
             CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
           FROM tablewright_orders GROUP BY o_orderstatus""",
    )


@query(
    "a19_row_to_csv_line",
    """SELECT concat_ws(',', CAST(n_nationkey AS VARCHAR), n_name,
         coalesce(CAST(CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS VARCHAR), 'null'))
         AS line FROM nation""",
)
def row_lines(t: Tables):
    region = F.when(F.col("n_regionkey") != 2, F.col("n_regionkey"))
    return csv_line(t.nation.withColumn("n_regionkey", region))


A20_SQL = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@query("a20_sink_single_csv", A20_SQL)
def single_csv(t: Tables):
    target = scratch_path(t.spark, "sink") + ".csv"
    write_single_csv(t.supplier, target)
    return files.read_csv_schema(t.spark, target, t.supplier.schema, header=True)


@query("a20_sink_csv_folder", A20_SQL)
def csv_folder(t: Tables):
    target = scratch_path(t.spark, "sink") + ".csv"
    write_csv(t.supplier, target)
    return files.read_csv_schema(t.spark, target, t.supplier.schema, header=True)


@query(
    "a21_sink_many",
    """SELECT 'nation' AS target, n_name AS name FROM nation
       UNION ALL SELECT 'region', r_name FROM region
       UNION ALL SELECT 'other', r_name FROM region""",
)
def many(t: Tables):
    folder = scratch_path(t.spark, "sinks")
    names = {
        "nation": t.nation.select(F.col("n_name").alias("name")),
        "region": t.region.select(F.col("r_name").alias("name")),
    }
    targets = {n: f"{folder}/target={n}" for n in ["nation", "region", "other"]}
    write_many(names, targets, default=names["region"])
    written = t.spark.read.schema("name string, target string").csv(folder, header=True)
    return written.select("target", "name")


@query(
    "a22_plan_matrix",
    """SELECT 'trans' || CAST(s_nationkey % 5 + 1 AS VARCHAR) AS transform,
         CAST(max(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS rank,
         CAST(max(CASE WHEN s_suppkey % 3 = 1 THEN 1 ELSE 0 END) AS INTEGER) AS city,
         CAST(max(CASE WHEN s_suppkey % 3 = 2 THEN 1 ELSE 0 END) AS INTEGER) AS income
       FROM supplier GROUP BY 1""",
)
def matrix(t: Tables):
    chosen = t.supplier.select(
        F.concat(F.lit("trans"), F.col("s_nationkey") % 5 + 1).alias("transform"),
        F.element_at(
            F.array(F.lit("rank"), F.lit("city"), F.lit("income")),
            (F.col("s_suppkey") % 3 + 1).cast("int"),
        ).alias("column"),
    )
    return plan_matrix(chosen, ["rank", "city", "income"])


@query(
    "a23_sink_predictions_text",
    """SELECT CAST(p_partkey AS VARCHAR) || ' ' || CAST(p_size % 4 AS VARCHAR) AS value FROM part""",
)
def predictions_text(t: Tables):
    path = scratch_path(t.spark, "predictions")
    scored = t.part.withColumn("prediction", F.col("p_size") % 4)
    prediction_lines(scored, "prediction", F.col("p_partkey").cast("string")).write.text(path)
    return t.spark.read.text(path)
