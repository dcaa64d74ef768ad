"""The engine's logical inputs as views of the test tables, in Spark and in SQL (names of CTEs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.readers import read_table
from quern.staging import Stages


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """user, item, stars: a row per order line."""
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"), F.col("l_quantity").alias("stars"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """user, item, stars: repeated ratings by their mean."""
    return interactions(spark, d).groupBy("user", "item").agg(F.avg("stars").alias("stars"))


def split_ratings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test pairs, held-out ratings); the test pairs also hold an unknown user and an unknown item. Ratings are written once, as all three are read repeatedly."""
    every = Stages(spark, "ratings").write(ratings(spark, d))
    held = (F.col("user") + F.col("item")) % 50 == 0
    cold = spark.createDataFrame([(-1, 1), (1, -1)], "user long, item long")
    return every.where(~held), every.where(held).select("user", "item").unionByName(cold), every.where(held)


RATINGS = """
ratings AS (SELECT o_custkey AS "user", l_suppkey AS item, avg(l_quantity) AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
train AS (SELECT * FROM ratings WHERE ("user" + item) % 50 <> 0),
test AS (SELECT "user", item FROM ratings WHERE ("user" + item) % 50 = 0 UNION ALL SELECT -1, 1 UNION ALL SELECT 1, -1)"""


def brand_pairs(spark: SparkSession, d: str) -> DataFrame:
    """basket (an order), item (a brand), distinct."""
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = read_table(spark, d, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()


BRANDS = "pairs AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def event_pairs(spark: SparkSession, d: str) -> DataFrame:
    """basket (``date-user``), item (an event type), distinct."""
    e = read_table(spark, d, "events")
    return e.select(F.concat_ws("-", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd"), F.col("user_id")).alias("basket"), F.col("event_type").alias("item")).distinct()


EVENT_PAIRS = "pairs AS (SELECT DISTINCT strftime(ts, '%Y%m%d') || '-' || CAST(user_id AS VARCHAR) AS basket, event_type AS item FROM events)"


def document_words(spark: SparkSession, d: str) -> DataFrame:
    """id, item: distinct lower-case words between spaces, of all documents."""
    docs = read_table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("item")).where("item <> ''")


def document_sets(spark: SparkSession, d: str) -> DataFrame:
    """id, items: the words of ``document_words`` with a row per id, which are shuffled only where ids repeat."""
    docs = read_table(spark, d, "documents").where("doc_id is not null")
    words = F.array_remove(F.array_distinct(F.split(F.lower("text"), " ")), "")
    sets = docs.select(F.col("doc_id").alias("id"), words.alias("items")).where("size(items) > 0")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return sets
    return sets.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


WORDS = "words AS (SELECT DISTINCT doc_id AS id, item FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS item FROM documents) WHERE item <> '')"


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """user, item: the parts that a customer ordered, distinct."""
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).distinct()


def graph(spark: SparkSession, d: str) -> DataFrame:
    """src < dst, common: all pairs of customers that share two parts or more."""
    from quern.operators.graph import co_graph

    return co_graph(part_pairs(spark, d), 2)


def brand_graph(spark: SparkSession, d: str) -> DataFrame:
    """src < dst, common: brands that orders hold together at least as often as chance would have it; 25 brands at any scale."""
    from quern.operators.graph import co_graph

    pairs = brand_pairs(spark, d)
    held = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    baskets = pairs.agg(F.count_distinct("basket").alias("baskets"))
    together = co_graph(pairs.select(F.col("item").alias("user"), F.col("basket").alias("item")), 1)
    x, y = (held.select(F.col("item").alias(c), F.col("n").alias(f"n_{c}")) for c in ("src", "dst"))
    return together.join(x, "src").join(y, "dst").crossJoin(baskets).where("common * baskets >= n_src * n_dst").select("src", "dst", "common")


GRAPH = """
pairs AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT a.u AS src, b.u AS dst, count(*) AS common FROM pairs a JOIN pairs b ON a.i = b.i AND a.u < b.u GROUP BY 1, 2 HAVING count(*) >= 2),
two AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
nodes AS (SELECT DISTINCT src AS node FROM two)"""


def stream(spark: SparkSession, d: str) -> DataFrame:
    """batch_id (days from 2024-01-01), seq, key."""
    return stream_rows(read_table(spark, d, "events"))


def stream_rows(events: DataFrame) -> DataFrame:
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    return events.select(day.alias("batch_id"), F.col("event_id").alias("seq"), (F.col("user_id") * 1000 + F.when(k == "", F.lit("0")).otherwise(k).cast("long")).alias("key"))


STREAM = """stream AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS batch_id, event_id AS seq, user_id * 1000 + CAST(CASE WHEN k = '' THEN '0' ELSE k END AS BIGINT) AS key FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events))"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """point_id, label, features."""
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.col("embedding").alias("features"))
