"""Connected components of a link table, each named by its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.storage import cut_lineage, discard


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b), which may repeat and point either way.

    Alternates large-star and small-star steps: a node hands its neighbours to
    the smallest of them, until every link points at the smallest node of its
    component.  A step is a grouped minimum and a join, never a list of
    neighbours, so a node of any degree is no task of its own.
    """
    arcs = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "arcs")
    while True:
        mark = arcs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not mark[0]:
            break
        both = arcs.unionByName(arcs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large, "arcs")
        discard(arcs)
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = small_least.select("a", F.col("m").alias("b"))
        arcs = cut_lineage(handed.unionByName(own).distinct(), "arcs")
        discard(large)
        if arcs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == mark:
            break
    roots = arcs.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
