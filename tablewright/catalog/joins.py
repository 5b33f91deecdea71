"""Queries of group C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import Tables, query
from tablewright.operators import joins


@query(
    "c01_join_equi_residual_having",
    """SELECT x.str, count(*) AS n
       FROM (SELECT p_partkey AS num, CAST(p_size AS VARCHAR) AS str FROM part) x
       JOIN (SELECT p_partkey AS num, CAST(p_size AS VARCHAR) AS str FROM part) y ON x.str = y.str
        AND x.num > 0 AND y.num > 100
       GROUP BY x.str HAVING CAST(x.str AS INTEGER) > 2""",
)
def equi_residual_having(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("num"), F.col("p_size").cast("string").alias("str"))
    counts = joins.self_join_counts(rows, "str", "num > 0", "num > 100")
    return counts.filter(F.col("str").cast("int") > 2)


@query(
    "c02_join_null_safe",
    """SELECT n.n_name AS state, CAST(sum(c.bal) AS DOUBLE) AS balance, CAST(sum(c.custs) AS BIGINT) AS customers,
         CAST(sum(c.keys) AS BIGINT) AS key_sum
       FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS k,
               CAST(c_acctbal AS DECIMAL(18, 2)) AS bal, 1 AS custs, c_custkey AS keys FROM customer
             WHERE c_mktsegment <> 'BUILDING') c
       JOIN (SELECT CASE WHEN n_nationkey % 10 = 0 THEN NULL ELSE n_nationkey END AS k, n_name FROM nation) n
         ON c.k IS NOT DISTINCT FROM n.k
       GROUP BY n.n_name ORDER BY state DESC""",
)
def null_safe(t: Tables):
    # Customers are summed per key before the join, so a hot key, and the null
    # key in particular, is one row when it meets its partners.
    customers = (
        t.customer.filter("c_mktsegment <> 'BUILDING'")
        .select(
            F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("k"),
            F.col("c_acctbal").cast("decimal(18,2)").alias("bal"),
            "c_custkey",
        )
        .groupBy("k")
        .agg(
            F.sum("bal").alias("bal"),
            F.count("*").alias("custs"),
            F.sum("c_custkey").alias("keys"),
        )
    )
    nations = t.nation.select(
        F.when(F.col("n_nationkey") % 10 != 0, F.col("n_nationkey")).alias("nk"),
        F.col("n_name").alias("state"),
    )
    joined = joins.join_null_safe(customers, nations, [("k", "nk")])
    return (
        joined.groupBy("state")
        .agg(
            F.sum("bal").cast("double").alias("balance"),
            F.sum("custs").alias("customers"),
            F.sum("keys").alias("key_sum"),
        )
        .orderBy(F.col("state").desc())
    )


@query(
    "c03_join_null_safe_range",
    """SELECT o.cust AS artist_id, count(*) AS "Plays", l.ds AS "Ds",
         max(o.price) AS "initCount", max(o.day) AS pub_date
       FROM (SELECT CASE WHEN o_orderkey % 5003 = 0 THEN NULL ELSE o_orderkey END AS k, o_custkey AS cust,
               o_totalprice AS price, strftime(o_orderdate, '%Y%m%d') AS day FROM orders) o
       JOIN (SELECT CASE WHEN l_orderkey % 5003 = 0 THEN NULL ELSE l_orderkey END AS k, l_returnflag AS flag,
               strftime(l_shipdate, '%Y%m%d') AS ds FROM lineitem) l
         ON o.k IS NOT DISTINCT FROM l.k AND o.day >= l.ds
       WHERE l.flag = 'R' GROUP BY o.cust, l.ds""",
)
def null_safe_range(t: Tables):
    # Days stay dates until the end: the maximum of a text would need a sort.
    # Actions are counted per song and day first, so a hot song, and rows
    # without a song, are one row per day when they meet their partners.
    songs = t.orders.select(
        F.when(F.col("o_orderkey") % 5003 != 0, F.col("o_orderkey")).alias("song_id"),
        F.col("o_custkey").alias("artist_id"),
        F.col("o_totalprice").alias("price"),
        F.to_date("o_orderdate").alias("publish_time"),
    )
    actions = (
        t.lineitem.filter("l_returnflag = 'R'")
        .select(
            F.when(F.col("l_orderkey") % 5003 != 0, F.col("l_orderkey")).alias("action_song"),
            F.to_date("l_shipdate").alias("Ds"),
        )
        .groupBy("action_song", "Ds")
        .agg(F.count("*").alias("actions"))
    )
    later = F.col("publish_time") >= F.col("Ds")
    joined = joins.join_null_safe(songs, actions, [("song_id", "action_song")], later)
    return (
        joined.groupBy("artist_id", "Ds")
        .agg(
            F.sum("actions").alias("Plays"),
            F.max("price").alias("initCount"),
            F.max("publish_time").alias("pub_date"),
        )
        .orderBy("artist_id", "Ds")
        .select(
            "artist_id",
            "Plays",
            F.date_format("Ds", "yyyyMMdd").alias("Ds"),
            "initCount",
            F.date_format("pub_date", "yyyyMMdd").alias("pub_date"),
        )
    )


@query(
    "c04_join_pairs",
    """SELECT o_custkey AS key, o_totalprice AS value, c_name AS other
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def pairs(t: Tables):
    left = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"))
    right = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("other"))
    return joins.join_pairs(left, right, "key")


@query(
    "c05_join_items_products",
    """SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS quantity, p_name
       FROM lineitem JOIN part ON CAST(l_partkey AS VARCHAR) = CAST(p_partkey AS VARCHAR)""",
)
def items_products(t: Tables):
    items = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"))
    products = t.part.select("p_partkey", "p_name")
    joined = joins.join_star(items, [(products, {"l_partkey": "p_partkey"})])
    return joined.select("l_orderkey", "quantity", "p_name")


@query(
    "c06_join_multi_key",
    """SELECT o_orderkey, o_totalprice, d.lines, d.quantity FROM orders JOIN
         (SELECT year(l_shipdate) AS y, month(l_shipdate) AS m, day(l_shipdate) AS d, count(*) AS lines,
            CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
          FROM lineitem GROUP BY ALL) d
       ON year(o_orderdate) = d.y AND month(o_orderdate) = d.m AND day(o_orderdate) = d.d""",
)
def multi_key(t: Tables):
    def parts(column, prefix):
        return [
            F.year(column).alias(f"{prefix}y"),
            F.month(column).alias(f"{prefix}m"),
            F.dayofmonth(column).alias(f"{prefix}d"),
        ]

    daily = (
        t.lineitem.groupBy(*parts("l_shipdate", "day_"))
        .agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    )
    fact = t.orders.select("o_orderkey", "o_totalprice", *parts("o_orderdate", "o_"))
    keys = {"o_y": "day_y", "o_m": "day_m", "o_d": "day_d"}
    joined = joins.join_star(fact, [(daily, keys)])
    return joined.select("o_orderkey", "o_totalprice", "lines", "quantity")


@query(
    "c07_join_star_three",
    """SELECT l_orderkey, l_quantity, l_shipdate, o_orderdate, o_orderpriority, c_name, c_mktsegment, d.orders AS day_orders
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
       JOIN (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, count(*) AS orders
             FROM orders GROUP BY ALL) d
         ON year(l_shipdate) = d.y AND month(l_shipdate) = d.m AND day(l_shipdate) = d.d""",
)
def star_three(t: Tables):
    lines = t.lineitem.select(
        "l_orderkey",
        "l_quantity",
        "l_shipdate",
        F.year("l_shipdate").alias("y"),
        F.month("l_shipdate").alias("m"),
        F.dayofmonth("l_shipdate").alias("d"),
    )
    calendar = t.orders.groupBy(
        F.year("o_orderdate").alias("day_y"),
        F.month("o_orderdate").alias("day_m"),
        F.dayofmonth("o_orderdate").alias("day_d"),
    ).agg(F.count("*").alias("day_orders"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    joined = joins.join_star(
        lines,
        [
            (calendar, {"y": "day_y", "m": "day_m", "d": "day_d"}),
            (orders, {"l_orderkey": "o_orderkey"}),
            (customers, {"o_custkey": "c_custkey"}),
        ],
    )
    return joined.select(
        "l_orderkey", "l_quantity", "l_shipdate", "o_orderdate", "o_orderpriority", "c_name",
        "c_mktsegment", "day_orders",
    )


@query(
    "c08_join_left_anti",
    """SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS
         (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
)
def left_anti(t: Tables):
    returned = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.join_unmatched(t.orders.select("o_orderkey", "o_custkey"), returned, ["o_orderkey"])


@query(
    "c09_join_cartesian_where",
    """SELECT event_id, event_type, c_name, c_mktsegment FROM events, customer WHERE user_id = c_custkey""",
)
def product_where(t: Tables):
    events = t.events.select("event_id", "event_type", "user_id")
    customers = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    joined = joins.join_star(events, [(customers, {"user_id": "c_custkey"})])
    return joined.select("event_id", "event_type", "c_name", "c_mktsegment")


@query(
    "c10_join_self_pairs",
    """WITH items AS (SELECT l_orderkey, p_name, row_number() OVER (ORDER BY l_orderkey, p_name) AS rid
                      FROM lineitem JOIN part ON l_partkey = p_partkey)
       SELECT a.l_orderkey, count(b.rid) AS pairs, count(*) FILTER (WHERE a.p_name = b.p_name) AS equal_pairs,
         count(*) FILTER (WHERE a.p_name <> b.p_name) AS unequal_pairs
       FROM items a LEFT JOIN items b ON a.l_orderkey = b.l_orderkey AND a.rid < b.rid
       GROUP BY a.l_orderkey""",
)
def self_pairs(t: Tables):
    products = t.part.select("p_partkey", "p_name")
    items = t.lineitem.select("l_orderkey", "l_partkey")
    named = joins.join_star(items, [(products, {"l_partkey": "p_partkey"})])
    return joins.pair_counts(named, "l_orderkey", "p_name")


@query(
    "c11_join_by_row_order",
    """SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def by_row_order(t: Tables):
    return joins.join_pairs(
        t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), "doc_id"
    )
