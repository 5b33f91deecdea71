"""Queries of group D: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import Tables, query
from tablewright.functions import text
from tablewright.operators import aggregates
from tablewright.operators.cooccurrence import cooccurrence_topk
from tablewright.operators.joins import join_star
from tablewright.operators.request import count_rows


@query(
    "d01_agg_sums_sorted",
    """SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price,
         CAST(sum(CAST(l_tax AS DECIMAL(18, 2))) AS DOUBLE) AS tax
       FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag DESC""",
)
def sums_sorted(t: Tables):
    names = {"quantity": "l_quantity", "price": "l_extendedprice", "tax": "l_tax"}
    exact = t.lineitem.select(
        "l_returnflag", *[F.col(c).cast("decimal(18,2)").alias(n) for n, c in names.items()]
    )
    sums = aggregates.sums_sorted(exact, "l_returnflag", list(names))
    return sums.withColumns({n: F.col(n).cast("double") for n in names})


@query(
    "d02_agg_count_max",
    """SELECT o_custkey AS artist_id, o_orderpriority AS "Ds", count(o_orderstatus) AS "Plays",
         max(o_totalprice) AS "initCount", max(o_orderdate) AS pub_date
       FROM orders GROUP BY o_custkey, o_orderpriority ORDER BY artist_id, "Ds" """,
)
def count_max(t: Tables):
    return (
        t.orders.groupBy(F.col("o_custkey").alias("artist_id"), F.col("o_orderpriority").alias("Ds"))
        .agg(
            F.count("o_orderstatus").alias("Plays"),
            F.max("o_totalprice").alias("initCount"),
            F.max("o_orderdate").alias("pub_date"),
        )
        .orderBy("artist_id", "Ds")
    )


@query(
    "d03_agg_by_type",
    """SELECT c_nationkey, c_mktsegment, max(c_custkey) AS c_custkey, count(c_name) AS c_name,
         count(c_acctbal) AS c_acctbal FROM customer GROUP BY c_nationkey, c_mktsegment""",
)
def by_type(t: Tables):
    return aggregates.aggregate_by_type(t.customer, ["c_nationkey", "c_mktsegment"])


@query(
    "d03_agg_by_type_int",
    """SELECT p_type, max(p_partkey) AS p_partkey, count(p_name) AS p_name, count(p_brand) AS p_brand,
         min(p_size) AS p_size, count(p_retailprice) AS p_retailprice FROM part GROUP BY p_type""",
)
def by_type_int(t: Tables):
    return aggregates.aggregate_by_type(t.part, ["p_type"])


@query("d04_agg_count_by_category", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def by_category(t: Tables):
    return aggregates.count_by(t.events, "event_type")


@query(
    "d04_agg_count_by_category_filtered",
    "SELECT p_type, count(*) AS n FROM part WHERE p_size > 40 GROUP BY p_type",
)
def by_category_filtered(t: Tables):
    return aggregates.count_by(t.part, "p_type", "p_size > 40")


@query(
    "d05_rate_table",
    """WITH rows AS (SELECT CASE WHEN p_size = 50 THEN NULL ELSE p_type END AS category, l_returnflag = 'R' AS hit
                     FROM lineitem JOIN part ON l_partkey = p_partkey)
       SELECT category, count(*) FILTER (WHERE hit) / count(*) AS rate, count(*) FILTER (WHERE hit) AS hits,
         count(*) AS total, count(*) FILTER (WHERE hit) / (SELECT count(*) FROM rows WHERE hit) AS hits_to_all_hits,
         count(*) FILTER (WHERE hit) / count(*) AS hits_to_total,
         count(*) / (SELECT count(*) FROM rows) AS total_to_all
       FROM rows WHERE category IS NOT NULL GROUP BY category
       HAVING count(*) FILTER (WHERE hit) > 0 ORDER BY rate DESC, category""",
)
def rates(t: Tables):
    kinds = t.part.select("p_partkey", F.when(F.col("p_size") != 50, F.col("p_type")).alias("category"))
    lines = t.lineitem.select("l_partkey", "l_returnflag")
    rows = join_star(lines, [(kinds, {"l_partkey": "p_partkey"})])
    return aggregates.rate_table(rows, "category", "l_returnflag = 'R'")


@query(
    "d06_word_count",
    """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
       GROUP BY word""",
)
def words(t: Tables):
    return text.word_count(t.documents, "text")


STOP_WORDS_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(text.TITLE_STOP_WORDS))
TITLE_TOKENS_SQL = f"""SELECT doc_id, token FROM (
  SELECT doc_id, lower(unnest(regexp_split_to_array(text, '\\W+'))) AS token FROM documents)
  WHERE length(token) >= 2 AND NOT regexp_matches(token, '[0-9]') AND token NOT IN ({STOP_WORDS_SQL})"""


@query("d07_distinct_token_count", f"SELECT count(DISTINCT token) AS n FROM ({TITLE_TOKENS_SQL})")
def distinct_tokens(t: Tables):
    return text.distinct_tokens(t.documents, "doc_id", "text")


@query(
    "d08_cooccurrence_topk",
    """WITH items AS (SELECT l_orderkey AS o, p_name AS name, sum(l_quantity) AS q,
                        sum(l_quantity * l_quantity) AS q2, count(*) AS n
                      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
       pairs AS (
         SELECT a.name AS item_a, b.name AS item_b,
           CASE WHEN a.name = b.name THEN (a.q * a.q - a.q2) / 2 ELSE a.q * b.q END AS w
         FROM items a JOIN items b ON a.o = b.o AND a.name <= b.name
         WHERE a.name < b.name OR a.n > 1)
       SELECT item_a, item_b, sum(w) AS weight FROM pairs GROUP BY ALL
       ORDER BY weight DESC, item_a, item_b LIMIT 10""",
)
def cooccurrence(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    named = join_star(lines, [(t.part.select("p_partkey", "p_name"), {"l_partkey": "p_partkey"})])
    return cooccurrence_topk(named, "l_orderkey", "p_name", "l_quantity", 10)


@query(
    "d09_collect_group",
    """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY place) - 1 AS chunk, "values" FROM (
         SELECT user_id, place, array_to_string(list(value ORDER BY value), ',') AS "values" FROM (
           SELECT user_id, value, (row_number() OVER (ORDER BY user_id, value) - 1) // 20 AS place
           FROM (SELECT user_id, CAST(value * 100 AS BIGINT) AS value FROM events))
         GROUP BY user_id, place)""",
)
def grouped_values(t: Tables):
    rows = t.events.select("user_id", F.round(F.col("value") * 100).cast("long").alias("value"))
    groups = aggregates.collect_group(rows, "user_id", "value", chunk_size=20)
    joined = F.array_join(F.col("values").cast("array<string>"), ",")
    return groups.select("user_id", "chunk", joined.alias("values"))


@query("d10_count_rows", "SELECT count(*) AS count FROM lineitem")
def rows(t: Tables):
    return count_rows(t.lineitem)


@query(
    "d11_plan_score",
    """SELECT plan, round(sum(error) / nullif(power(sum(weight), 1.5), 0), 9) AS score FROM (
         SELECT l_suppkey AS plan, 1 + (l_linenumber - 1) % 4 AS weight,
           round(avg(l_discount) * 5 - 0.2, 9) AS error
         FROM lineitem GROUP BY ALL) WHERE error > 0 GROUP BY plan""",
)
def score(t: Tables):
    levels = t.lineitem.groupBy(
        F.col("l_suppkey").alias("plan"), (1 + (F.col("l_linenumber") - 1) % 4).alias("weight")
    ).agg(F.round(F.avg("l_discount") * 5 - 0.2, 9).alias("error"))
    scored = aggregates.plan_score(levels, "plan", "error", "weight")
    return scored.withColumn("score", F.round("score", 9))
