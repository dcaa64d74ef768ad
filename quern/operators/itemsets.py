"""Frequent itemsets: level-wise counting, two-pass partitioned counting, FP-growth, and basket preparation."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.staging import Stages


def baskets(df: DataFrame, basket_col: str, item_col: str, larger_than: int | None = None) -> DataFrame:
    """basket, item: distinct pairs, of baskets with more than ``larger_than`` items if given. Nulls are left out.

    Swapping the two columns gives the other orientation.
    """
    pairs = df.select(F.col(basket_col).alias("basket"), F.col(item_col).alias("item")).where("basket is not null and item is not null").distinct()
    if larger_than is None:
        return pairs
    large = pairs.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > larger_than)
    return pairs.join(large, "basket", "left_semi")


def retail_pairs(df: DataFrame, date_col: str, customer_col: str, product_col: str) -> DataFrame:
    """basket (``date-customer``, the year cut to two digits), item (the product as a number without leading zeros, as text)."""
    day = F.regexp_replace(F.col(date_col), r"(\d{2})(\d{2})$", "$2")
    return df.select(F.concat_ws("-", day, customer_col).alias("basket"), F.col(product_col).cast("long").cast("string").alias("item"))


def _levels(pairs: DataFrame, need: DataFrame, max_size: int | None) -> DataFrame:
    """part, items, n of itemsets that reach ``need`` (part, need) within their part. ``pairs``: part, basket, item.

    A level's occurrences are the baskets that hold its frequent sets, written so that the next level extends
    just these by frequent larger items: an occurrence survives only if its set is frequent (A-Priori).
    """
    stages = Stages(pairs.sparkSession, "itemsets")

    def frequent(occurrences: DataFrame) -> DataFrame:
        counts = occurrences.groupBy("part", "items").agg(F.count(F.lit(1)).alias("n"))
        return counts.join(F.broadcast(need), "part").where(F.col("n") >= F.col("need")).select("part", "items", "n")

    single = pairs.select("part", "basket", F.array("item").alias("items"))
    out = level = stages.write(frequent(single))
    kept = stages.write(pairs.join(level.select("part", F.get("items", F.lit(0)).alias("item")), ["part", "item"], "left_semi"))
    held = kept.select("part", "basket", F.array("item").alias("items"))
    size = 1
    while (max_size is None or size < max_size) and level.limit(1).count():
        longer = held.join(kept, ["part", "basket"]).where(F.col("item") > F.element_at("items", -1)).select("part", "basket", F.concat("items", F.array("item")).alias("items"))
        if size > 1:  # every subset must be frequent; the one without the first item prunes the most
            tail = level.select("part", F.col("items").alias("tail"))
            longer = longer.withColumn("tail", F.slice("items", 2, size)).join(tail, ["part", "tail"], "left_semi").drop("tail")
        longer = stages.write(longer)
        level = stages.write(frequent(longer))
        held = longer.join(level.select("part", "items"), ["part", "items"], "left_semi")
        out = out.unionByName(level)
        size += 1
    return out


def frequent_itemsets(pairs: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """items (a sorted array), n: all itemsets in ``support`` baskets or more. ``pairs``: basket, item, distinct."""
    need = pairs.sparkSession.createDataFrame([(0, float(support))], "part int, need double")
    return _levels(pairs.withColumn("part", F.lit(0)), need, max_size).select("items", "n")


def son_candidates(pairs: DataFrame, support: int, parts: int, max_size: int | None = None) -> DataFrame:
    """items: itemsets frequent in a part of the baskets under the scaled support. Which they are depends on ``parts``; diagnostic."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("basket"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("part").agg(F.count_distinct("basket").alias("n"))
    total = pairs.select("basket").distinct().count()
    return _levels(dealt, sizes.select("part", (F.col("n") * (support / max(total, 1))).alias("need")), max_size).select("items").distinct()


def son_itemsets(pairs: DataFrame, support: int, parts: int, max_size: int | None = None) -> DataFrame:
    """items, n: the candidates of ``son_candidates`` that are globally frequent, equal to ``frequent_itemsets``."""
    stages = Stages(pairs.sparkSession, "son")
    candidates = stages.write(son_candidates(pairs, support, parts, max_size).withColumn("size", F.size("items")))
    # A basket holds a candidate if as many of its items meet the candidate's items as the candidate has.
    wanted = candidates.select("items", "size", F.explode("items").alias("item"))
    met = pairs.join(wanted, "item").groupBy("basket", "items", "size").agg(F.count(F.lit(1)).alias("met")).where("met = size")
    return met.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)


def fp_growth(pairs: DataFrame, support: int) -> DataFrame:
    """The same by FP-growth."""
    stages = Stages(pairs.sparkSession, "fp-growth")
    sets = stages.write(pairs.groupBy("basket").agg(F.collect_list("item").alias("items")))
    least = max(0.0, (support - 0.5) / max(sets.count(), 1))  # a share that gives exactly the count
    model = FPGrowth(itemsCol="items", minSupport=min(least, 1.0)).fit(sets)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))


def shown(itemsets: DataFrame) -> DataFrame:
    """size, items (joined by commas), n."""
    return itemsets.select(F.size("items").cast("long").alias("size"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "n")
