"""Frequent and maximal item sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import stage


def frequent_itemsets(sets: DataFrame, min_support: int, most_items: int = 4) -> DataFrame:
    """``(items, support)``: all sorted item sets up to ``most_items`` found in ``min_support`` sets or more.

    ``sets`` has ``set_id, item``; repeats in one set count once. Level by level: a set of the
    next size is a frequent one joined, inside its set, with a larger frequent item, so only
    candidates whose parts are frequent are counted.
    """
    rows = sets.select("set_id", "item").distinct()
    single = rows.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    rows = stage(rows.join(single.select("item"), "item", "left_semi"), "items")
    out = single.select(F.array("item").alias("items"), "support")
    held = rows.select("set_id", F.array("item").alias("items"))
    for size in range(2, most_items + 1):
        grown = held.join(rows, "set_id").where(F.col("item") > F.element_at("items", -1)).select("set_id", F.concat("items", F.array("item")).alias("items"))
        level = stage(grown.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= min_support), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
        held = stage(grown.join(level.select("items"), "items", "left_semi"), "held")
    return out


def fp_growth(sets: DataFrame, min_support: int) -> DataFrame:
    """All frequent item sets of any size by parallel FP-growth: ``(items, support)``."""
    from pyspark.ml.fpm import FPGrowth

    baskets = sets.groupBy("set_id").agg(F.collect_set("item").alias("items"))
    n = max(1, baskets.count())
    model = FPGrowth(itemsCol="items", minSupport=(min_support - 0.5) / n, minConfidence=1.0).fit(baskets)
    return model.freqItemsets.select(F.sort_array("items").alias("items"), F.col("freq").alias("support"))


def maximal_sets(sets: DataFrame, most_items: int = 64) -> DataFrame:
    """``(set_id)`` of sets that are no proper subset of another; equal sets all stay.

    Equal sets are folded first. A set of one item lies in another if the item is in a larger set. Any other is
    looked up by its two rarest items, which a superset must hold. Sets of up to ``most_items`` offer all their pairs of items;
    a larger one, whose pairs would be too many, is met through the rarest item alone. Candidates are compared item by item. The joins are merges: as files
    the sets are far smaller than their pairs, so a choice by size would broadcast them.
    """
    held = stage(sets.groupBy("set_id").agg(F.sort_array(F.collect_set("item")).alias("items")), "sets")
    kinds = stage(held.groupBy("items").agg(F.min("set_id").alias("kind")).withColumn("size", F.size("items")), "kinds")
    rows = kinds.select("kind", "size", F.explode("items").alias("item"))
    spread = rows.groupBy("item").agg(F.count("*").alias("n"), F.max("size").alias("largest"))
    alone = kinds.where("size = 1").withColumn("item", F.col("items")[0]).join(spread.where("largest > 1"), "item", "left_semi").select("items")
    ranked = rows.where("size > 1").join(spread, "item").withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("n", "item")))
    two = ranked.where("r <= 2").groupBy("kind").agg(F.min("item").alias("a"), F.max("item").alias("b"), F.min(F.struct("r", "item")).getField("item").alias("rarest"))
    small = stage(kinds.join(two.hint("merge"), "kind").select("kind", "items", "size", "a", "b", "rarest"), "small")
    pairs = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    offered = kinds.where((F.col("size") > 2) & (F.col("size") <= most_items)).select(F.inline(pairs), F.col("size").alias("other_size"), F.col("items").alias("other"))
    vast = kinds.where(F.col("size") > most_items).select(F.explode("items").alias("rarest"), F.col("size").alias("other_size"), F.col("items").alias("other"))
    met = small.join(offered.hint("merge"), ["a", "b"]).select("items", "size", "other", "other_size").unionByName(small.join(vast.hint("merge"), "rarest").select("items", "size", "other", "other_size"))
    inside = met.where((F.col("other_size") > F.col("size")) & (F.size(F.array_except("items", "other")) == 0))
    return held.join(inside.select("items").unionByName(alone).distinct(), "items", "left_anti").select("set_id")
