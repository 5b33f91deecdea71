"""Queries of group G: scalar functions and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.aggregations import TITLE_TOKENS_SQL
from tablewright.catalog.registry import Tables, query
from tablewright.functions import features, scalars, text

IGNORED_SQL = ", ".join(f"'{w}'" for w in text.MESSAGE_IGNORED_WORDS)
CHARACTERS_SQL = text.MESSAGE_IGNORED_CHARACTERS.replace("'", "''")


@query(
    "g01_tokenize_clean",
    f"""WITH tokens AS ({TITLE_TOKENS_SQL}),
        common AS (SELECT token FROM tokens GROUP BY token HAVING count(*) >= 2)
        SELECT doc_id, token, count(*) AS n FROM tokens WHERE token IN (SELECT token FROM common)
        GROUP BY doc_id, token""",
)
def clean_tokens(t: Tables):
    tokens = text.clean_tokens(t.documents, "doc_id", "text")
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(
    "g02_tokenize_sms",
    f"""SELECT DISTINCT doc_id, token FROM (
          SELECT doc_id, unnest(string_split(translate(lower(text), '{CHARACTERS_SQL}',
            repeat(' ', {len(text.MESSAGE_IGNORED_CHARACTERS)})), ' ')) AS token FROM documents)
        WHERE length(token) > 2 AND token NOT IN ({IGNORED_SQL})""",
)
def message_tokens(t: Tables):
    return t.documents.select("doc_id", F.explode(text.message_tokens(F.col("text"))).alias("token"))


@query(
    "g03_parse_pageview",
    """SELECT event_type AS url, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS zip_code, CAST(user_id AS INTEGER) AS user_id
       FROM events""",
)
def page_views(t: Tables):
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    zip_code = F.get_json_object("props", "$.k").cast("int") % 10
    line = F.concat_ws("\t", "event_type", status, zip_code, "user_id")
    return t.events.select(line.alias("line")).select(*scalars.page_view(F.col("line")))


@query(
    "g04_refine_date",
    """SELECT o_orderkey, CAST(year(ts) AS INTEGER) AS "Year", CAST(month(ts) AS INTEGER) AS "Month", CAST(day(ts) AS INTEGER) AS "Day", CAST(week(ts) AS INTEGER) AS "WeekNum",
         CAST(hour(ts) AS INTEGER) AS "HourOfDay", CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS "Weekend",
         CASE WHEN month(ts) IN (3, 4, 5) THEN 'Spring' WHEN month(ts) IN (6, 7, 8) THEN 'Summer'
           WHEN month(ts) IN (9, 10, 11) THEN 'Autumn' ELSE 'Winter' END AS "Season",
         CAST(isodow(ts) AS INTEGER) AS "WeekDay" FROM (
           SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS ts FROM orders)""",
)
def refined_dates(t: Tables):
    hours = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    stamp = F.date_format(F.col("o_orderdate") + hours, "MM/dd/yyyy hh:mm:ss a")
    rows = t.orders.select("o_orderkey", stamp.alias("Date"))
    return scalars.refine_date(rows, "Date").drop("instant")


@query(
    "g05_date_string_reformat",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day FROM orders",
)
def reformatted(t: Tables):
    day = scalars.reformat_date(F.date_format("o_orderdate", "yyyyMMdd"))
    return t.orders.select("o_orderkey", day.alias("day"))


@query(
    "g06_label_buckets",
    """SELECT s_suppkey, abs(CAST(trunc(s_acctbal) AS BIGINT)) % 2 AS parity,
         abs(CAST(trunc(s_acctbal) AS BIGINT)) * 10 % 3 AS thirds FROM supplier""",
)
def buckets(t: Tables):
    value = F.col("s_acctbal")
    return t.supplier.select(
        "s_suppkey",
        scalars.label_parity(value).alias("parity"),
        scalars.label_thirds(value).alias("thirds"),
    )


@query(
    "g07_features_to_text",
    """SELECT p_partkey, CAST(p_size AS VARCHAR) || '.0 ' || CAST(p_retailprice AS VARCHAR) AS text FROM part""",
)
def feature_text(t: Tables):
    values = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return t.part.select("p_partkey", scalars.values_text(values).alias("text"))


@query(
    "g08_numeric_expressions",
    """SELECT c_custkey, 1 + 2 * c_acctbal AS affine, round(power(c_acctbal / 100, 2), 6) AS squared,
         round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS logged FROM customer""",
)
def numeric(t: Tables):
    value = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey",
        (1 + 2 * value).alias("affine"),
        F.round(F.pow(value / 100, F.lit(2)), 6).alias("squared"),
        F.round(scalars.natural_log(value), 6).alias("logged"),
    )


@query(
    "g09_udf_membership",
    """SELECT l_orderkey, l_suppkey, l_returnflag FROM lineitem
       WHERE l_suppkey IN (2, 4, 8, 16, 32) AND
         ((l_returnflag = 'R' AND l_linestatus = 'F') OR (l_returnflag = 'A' AND l_linestatus = 'O'))""",
)
def membership(t: Tables):
    member = scalars.membership_udf([2, 4, 8, 16, 32])
    pair = scalars.pair_membership_udf([("R", "F"), ("A", "O")])
    kept = t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus").filter(
        member("l_suppkey") & pair("l_returnflag", "l_linestatus")
    )
    return kept.drop("l_linestatus")


@query(
    "g10_row_map_transform",
    "SELECT s_suppkey, upper(s_name) AS s_name, s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier",
)
def row_map(t: Tables):
    def change(batch):
        return batch.assign(s_name=batch.s_name.str.upper(), s_acctbal=batch.s_acctbal * 2)

    return scalars.map_rows(t.supplier, change)


@query(
    "g12_sql_transformer",
    """SELECT l_orderkey, l_quantity, l_discount, l_quantity + l_discount AS v3, l_quantity * l_discount AS v4
       FROM lineitem""",
)
def sql_transformer(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_quantity", "l_discount")
    return features.run_statement(
        rows,
        "SELECT *, (l_quantity + l_discount) AS v3, (l_quantity * l_discount) AS v4 FROM __THIS__",
    )


@query(
    "g13_encode_uri_component",
    """SELECT page_id, replace(replace(replace(replace(replace(replace(url_encode(url), '+', '%20'),
         '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS encoded FROM pages""",
)
def encoded(t: Tables):
    return t.pages.select("page_id", scalars.encode_uri_component(F.col("url")).alias("encoded"))
