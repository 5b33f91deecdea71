"""Which items occur together in a basket, weighted by quantity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablewright.storage import cut_lineage

# Items of one basket joined per task; wider baskets are split.
BLOCK_ITEMS = 4096
# Catalogues up to this size are paired without looking for a floor first: a
# row then meets at most this many others.
SMALL_CATALOGUE = 256


def _sides(items: DataFrame, slice_left, slice_right) -> tuple[DataFrame, DataFrame]:
    """The two sides of a self join, each with its slice of the basket."""
    left = items.select(
        "basket",
        slice_left.alias("slice"),
        F.col("item").alias("item_a"),
        F.col("q").alias("_qa"),
        F.col("power").alias("_pa"),
    )
    right = items.select(
        "basket",
        slice_right.alias("slice"),
        F.col("item").alias("item_b"),
        F.col("q").alias("_qb"),
        F.col("power").alias("_pb"),
    )
    return left, right


def _pair_weights(items: DataFrame, wide: DataFrame | None, least_square: float) -> DataFrame:
    """Summed weight of every pair of unequal items that shares a basket.

    `items` has one row per basket and item, with `q` and the item's `power`.
    Pairs whose bound cannot reach `least_square` are not emitted.  A basket
    listed in `wide` is cut into slices of its items, each joined by a task of
    its own with the whole basket.
    """
    zero = F.lit(0)
    if wide is None:
        sides = [_sides(items, zero, zero)]
    else:
        narrow = items.join(wide, "basket", "left_anti")
        sliced = items.join(wide, "basket")
        own = F.pmod(F.xxhash64("item"), F.col("slices")).cast("int")
        every = F.explode(F.sequence(zero, F.col("slices") - 1))
        sides = [_sides(narrow, zero, zero), _sides(sliced, own, every)]
    weights = []
    for left, right in sides:
        pairs = left.join(right, ["basket", "slice"]).filter(F.col("item_a") < F.col("item_b"))
        if least_square > 0:
            pairs = pairs.filter(F.col("_pa") * F.col("_pb") >= least_square)
        weights.append(pairs.select("item_a", "item_b", (F.col("_qa") * F.col("_qb")).alias("w")))
    return reduce(DataFrame.unionByName, weights).groupBy("item_a", "item_b").agg(
        F.sum("w").alias("weight")
    )


def _wide_baskets(per_item: DataFrame) -> DataFrame | None:
    """Baskets of more than BLOCK_ITEMS items with their slice counts, if any."""
    wide = (
        per_item.groupBy("basket")
        .agg(F.count("*").alias("_width"))
        .filter(F.col("_width") > BLOCK_ITEMS)
        .select("basket", F.ceil(F.col("_width") / F.lit(BLOCK_ITEMS)).cast("int").alias("slices"))
    )
    wide = cut_lineage(wide, "wide")
    return None if wide.isEmpty() else wide


def _item_powers(per_item: DataFrame) -> DataFrame:
    """Power of each item, and the weight of its pairs with itself if it has any."""
    square = F.col("q") * F.col("q")
    twice = F.sum(F.when(F.col("n") > 1, square - F.col("q2")))
    return per_item.groupBy("item").agg(F.sum(square).alias("power"), (twice / 2).alias("weight"))


def cooccurrence_topk(
    df: DataFrame, basket: str, item: str, quantity: str, k: int = 10
) -> DataFrame:
    """The k item pairs of largest weight, summed over baskets.

    The weight of two rows is the product of their quantities.  Rows are first
    summed per basket and item, so equal items need no pairing at all:
    ((sum q)^2 - sum q^2) / 2.  For unequal items, Cauchy-Schwarz bounds the
    weight by sqrt(power_a * power_b), where an item's power is the sum of its
    squared basket quantities.  The exact weights among the most powerful
    items give a floor for the k-th place; only pairs whose bound reaches that
    floor are joined.  The result is exact.
    """
    summed = (
        df.filter(F.col(basket).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(basket).alias("basket"), F.col(item).alias("item"))
        .agg(
            F.sum(quantity).alias("q"),
            F.sum(F.col(quantity) * F.col(quantity)).alias("q2"),
            F.count("*").alias("n"),
        )
    )
    # Read by the floor, the item powers and the pairs: summed once, written once.
    per_item = cut_lineage(summed, "baskets")
    by_item = cut_lineage(_item_powers(per_item), "items")
    equal = by_item.filter(F.col("weight").isNotNull()).select(
        F.col("item").alias("item_a"), F.col("item").alias("item_b"), "weight"
    )

    items = by_item.count()
    wide = _wide_baskets(per_item) if items > BLOCK_ITEMS else None
    floor = 0.0
    if items > SMALL_CATALOGUE:
        leaders = by_item.orderBy(F.col("power").desc(), "item").limit(2 * k).select("item", "power")
        among_leaders = _pair_weights(per_item.join(leaders, "item"), wide, 0.0)
        leading = among_leaders.unionByName(equal).orderBy(F.col("weight").desc()).limit(k)
        found = leading.agg(F.count("*").alias("n"), F.min("weight").alias("least")).first()
        # Fewer than k pairs, or a floor at or below zero, rules nothing out.
        floor = float(found["least"]) if found["n"] == k and found["least"] > 0 else 0.0
    least_square = floor * floor * (1 - 1e-9)

    able = by_item.select("item", "power")
    if floor > 0:
        largest = by_item.agg(F.max("power")).first()[0]
        able = able.filter(F.col("power") * F.lit(float(largest)) >= least_square)
    unequal = _pair_weights(per_item.join(able, "item"), wide, least_square)
    return (
        unequal.unionByName(equal)
        .orderBy(F.col("weight").desc(), "item_a", "item_b")
        .limit(k)
    )
