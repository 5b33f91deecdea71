"""Frequent item-sets, association rules and sequences."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, FPGrowthModel, PrefixSpan
from pyspark.sql import DataFrame, functions as F

from tablewright.operators.ordering import numbered
from tablewright.storage import cut_lineage


def baskets(df: DataFrame, basket: str, item: str, min_support: float) -> DataFrame:
    """One array of distinct items per basket, without items too rare to matter.

    An item-set is no more frequent than its rarest item, so leaving such
    items out first is exact, and it bounds the arrays: at most
    average basket size / support items are that frequent.
    """
    distinct = cut_lineage(
        df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct(), "baskets"
    )
    n = distinct.agg(F.count_distinct("basket")).scalar()
    frequent = (
        distinct.groupBy("item")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= F.ceil(F.lit(min_support) * n))
        .select(F.col("item").alias("_item"))
    )
    marked = distinct.join(frequent, F.col("item") == F.col("_item"), "left")
    # Baskets left without items stay: they count towards the support.
    # Written once: the miner reads its baskets more than once.
    return cut_lineage(
        marked.groupBy("basket").agg(F.collect_list("_item").alias("items")), "items"
    )


def frequent_itemsets(
    items: DataFrame, min_support: float, min_confidence: float = 0.8, partitions: int | None = None
) -> FPGrowthModel:
    miner = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    # Adaptive execution may have left few input partitions; mining is costlier than reading.
    miner.setNumPartitions(partitions or items.sparkSession.sparkContext.defaultParallelism)
    return miner.fit(items)


def association_rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """Rules with one consequent from counted item-sets (items, freq).

    Confidence is the count of the whole set over that of the antecedent.
    """
    keyed = itemsets.select(F.array_sort("items").alias("items"), "freq")
    wholes = keyed.filter(F.size("items") > 1).select(
        "items", "freq", F.explode("items").alias("consequent")
    )
    split = wholes.withColumn("antecedent", F.array_except("items", F.array("consequent")))
    parts = keyed.select(F.col("items").alias("antecedent"), F.col("freq").alias("_part"))
    rules = split.join(parts, "antecedent").withColumn("confidence", F.col("freq") / F.col("_part"))
    return rules.filter(F.col("confidence") >= min_confidence).select(
        "antecedent", "consequent", "freq", "confidence"
    )


def mine_sequences(
    df: DataFrame, key: str, order: list[str], item: str, min_support: float, max_length: int = 5
) -> DataFrame:
    """Frequent sequences of single items, from long rows: (sequence, freq).

    A key's rows in `order` are its sequence, of any length: none is gathered
    in a row.  A prefix keeps, per key, the earliest place it can end at; the
    next item is sought behind it.  Ties in `order` go by item.  Null is a key
    like any other; a null item is no item, but its key counts.
    """
    numbers = numbered(df.select(F.col(key).alias("key"), F.col(item).alias("item"), *order), ["key", *order, "item"], "place")
    rows = cut_lineage(numbers.select("key", "item", "place"), "sequences")
    least = F.ceil(F.lit(min_support) * rows.select("key").distinct().count())
    ends = cut_lineage(rows.groupBy("item", "key").agg(F.min("place").alias("end")), "ends").filter("item IS NOT NULL")
    common = ends.groupBy("item").agg(F.count("*").alias("freq")).filter(F.col("freq") >= least)
    # A sequence goes by the number of its prefix and its last item: rows of keys do not carry it.
    number = F.monotonically_increasing_id().alias("number")
    found = cut_lineage(common.select(F.array("item").alias("sequence"), "freq", F.lit(-1).cast("long").alias("prefix"), F.col("item").alias("next"), number), "frequent")
    steps = rows.join(found.select(F.col("next").alias("item")), "item", "left_semi")
    steps = cut_lineage(steps.select(F.col("key").alias("of"), F.col("item").alias("next"), "place"), "steps")
    ends = ends.select(F.lit(-1).cast("long").alias("prefix"), F.col("item").alias("next"), "key", "end")
    result = found
    for _ in range(1, max_length):
        known = found.select("prefix", "next", "number")
        open_ends = ends.join(known, ["prefix", "next"]).select(F.col("number").alias("prefix"), "key", "end")
        behind = F.col("key").eqNullSafe(F.col("of")) & (F.col("place") > F.col("end"))
        longer = open_ends.join(steps, behind).groupBy("prefix", "next", "key").agg(F.min("place").alias("end"))
        ends = cut_lineage(longer, "ends")
        counted = ends.groupBy("prefix", "next").agg(F.count("*").alias("freq")).filter(F.col("freq") >= least)
        grown = counted.join(found.select(F.col("number").alias("prefix"), "sequence"), "prefix")
        found = cut_lineage(grown.select(F.concat("sequence", F.array("next")).alias("sequence"), "freq", "prefix", "next", number), "frequent")
        if found.isEmpty():
            break
        result = result.unionByName(found)
    return result.select("sequence", "freq")


def frequent_sequences(
    df: DataFrame, min_support: float = 0.5, max_length: int = 5, column: str = "sequence"
) -> DataFrame:
    """Frequent sequences of item-sets and their counts, where a row holds a sequence."""
    miner = PrefixSpan(minSupport=min_support, maxPatternLength=max_length, sequenceCol=column)
    return miner.findFrequentSequentialPatterns(df)
