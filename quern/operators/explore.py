"""Exploration of interactions: counts, rankings, partition statistics, grouped averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, id_col: str, date_col: str, user_col: str, item_col: str, part_of_date: str) -> DataFrame:
    """n_review, n_review_in_period, n_user, n_business in one row.

    Rows with a null or empty id don't count as reviews; the period is a substring of the date's text;
    distinct counts leave out nulls, as SQL does.
    """
    has_id = F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")
    return df.agg(
        F.count_if(has_id).alias("n_review"),
        F.count_if(F.col(date_col).cast("string").contains(part_of_date)).alias("n_review_in_period"),
        F.count_distinct(user_col).alias("n_user"),
        F.count_distinct(item_col).alias("n_business"),
    )


def top(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """key, n_rows: the ``n`` most frequent values, ties by value. A heap per partition, no full sort."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), key).limit(n)


def partition_stats(df: DataFrame, key: str, n_partition: int, buckets: int = 100) -> DataFrame:
    """partition, n_items under ``(key mod buckets) mod n_partition`` for a numeric key, or its hash; empty partitions are 0."""
    number = F.col(key) if dict(df.dtypes)[key] in ("int", "bigint", "smallint", "tinyint") else F.xxhash64(key)
    used = df.groupBy(F.pmod(F.pmod(number, F.lit(buckets)), F.lit(n_partition)).cast("long").alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(n_partition).withColumnRenamed("id", "partition")
    return every.join(used, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n_items"))


def physical_partitions(df: DataFrame, n_partition: int | None = None, *key: str) -> DataFrame:
    """partition, n_items as the rows lie, after ``repartition(n_partition, *key)`` if given; empty partitions are 0."""
    dealt = df.repartition(n_partition, *key) if n_partition and key else df.repartition(n_partition) if n_partition else df
    n = n_partition or dealt.rdd.getNumPartitions()
    used = dealt.groupBy(F.spark_partition_id().cast("long").alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(n).withColumnRenamed("id", "partition")
    return every.join(used, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n_items"))


def grouped_average(facts: DataFrame, dimension: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """group, average over all facts of the group's keys, by average downwards, then group; groups without facts are absent."""
    joined = facts.select(key, value).join(dimension.select(key, group), key)
    return joined.groupBy(group).agg(F.avg(value).alias("average")).orderBy(F.desc("average"), group)


def outer_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All of ``left`` with the matching rows of ``right``, nulls where there are none."""
    return left.join(right, key, "left")


def feedback_mean(df: DataFrame, user_col: str, *counts: str) -> DataFrame:
    """user, mean over rows of the sum of ``counts``."""
    total = F.col(counts[0])
    for c in counts[1:]:
        total = total + F.col(c)
    return df.groupBy(user_col).agg(F.avg(total).alias("feedback_mean"))


def set_operation(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Distinct rows of union, intersect or except of two tables of equal columns."""
    if how == "union":
        return left.unionByName(right).distinct()
    return left.intersect(right) if how == "intersect" else left.subtract(right)
