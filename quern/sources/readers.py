"""Typed readers. Schemas are declared; malformed lines fail instead of becoming nulls unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.staging import Stages

REVIEW = "review_id string, user_id string, business_id string, date string, stars double, useful int, funny int, cool int"
BUSINESS = "business_id string, city string, stars double, review_count int"
USER = "user_id string, average_stars double, review_count int, yelping_since string"
RATINGS = "user_id string, business_id string, stars double"
PAIRS = "user_id string, business_id string"


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines under a declared schema; absent fields are null."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """CSV as in RFC 4180 (quotes doubled inside quotes; a UTF-8 byte-order mark is skipped); only the first line of a file is its header."""
    return spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').option("mode", mode).csv(path)


def read_points(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """point_id, label, features from header-less lines ``id,label,x1,...,xd`` with any number of features.

    With ``header`` the lines whose first field is no number are dropped.
    """
    fields = F.split("value", ",")
    rows = spark.read.text(path).where(F.trim("value") != "").select(fields.alias("f"))
    if header:
        rows = rows.where(F.expr("try_cast(f[0] AS bigint)").isNotNull())
    features = F.transform(F.slice("f", 3, F.size("f") - 2), lambda x: x.cast("double"))
    return rows.select(F.get("f", F.lit(0)).cast("long").alias("point_id"), F.get("f", F.lit(1)).alias("label"), features.alias("features"))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """key: a stream file's lines."""
    return spark.read.text(path).withColumnRenamed("value", "key")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def simulated_stream(keys: DataFrame, batches: int, size: int, seed: int = 553) -> DataFrame:
    """batch_id, seq, key: ``batches`` draws of ``size`` keys each, uniformly with replacement, reproducible by ``seed``.

    ``keys`` needs the columns position (0, 1, ...) and key. The draws are made by a join, so neither side is collected.
    """
    spark = keys.sparkSession
    n = keys.count()
    draws = spark.range(batches * size).select((F.col("id") / size).cast("int").alias("batch_id"), F.col("id").alias("seq"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("position"))
    return draws.join(keys.select(F.col("position").cast("long").alias("position"), "key"), "position").select("batch_id", "seq", "key")


def indexed(df: DataFrame, column: str, name: str = "position") -> DataFrame:
    """Distinct values with dense numbers from 0 in sorted order, without one task that sees all rows.

    Values are range-partitioned and sorted; the sizes of the partitions give each its first number. They are written
    before they are counted: bounds are sampled and partitions coalesced anew whenever a sort runs again.
    """
    spark = df.sparkSession
    values = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
    rows = Stages(spark, "indexed").write(values.withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    first, total = [], 0
    for p in sorted(sizes):
        first.append((p, total))
        total += sizes[p]
    starts = spark.createDataFrame(first or [(0, 0)], "_part int, _first long")
    return rows.join(F.broadcast(starts), "_part").select(column, (F.col("_first") + F.col("_local")).alias(name))
