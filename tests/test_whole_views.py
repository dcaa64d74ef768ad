"""The views of the test tables leave no row out."""

import pytest
from pyspark.sql import functions as F

from quern.operators.recommend import neighbours
from quern.operators.similarity import pearson_pairs
from quern.plans.catalogue import ORACLE_SQL, QUERIES
from quern.sources.readers import indexed
from tests.oracle import same


@pytest.mark.parametrize("name", ["jaccard_exact_pairs", "jaccard_lsh_pairs"])
def test_long_documents_and_unknown_lengths_take_part(spark, tmp_path, name):
    long = " ".join(f"word{i}" for i in range(1000))
    rows = [(1, long, len(long)), (2, long + " more", len(long) + 5), (3, "a b c", None), (4, "a b c", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["a"], r["b"]): r["similarity"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {(1, 2): round(1000 / 1001, 6), (3, 4): 1.0}


@pytest.mark.parametrize("name", ["jaccard_exact_pairs", "jaccard_lsh_pairs"])
def test_all_documents_equal_sql_over_the_whole_table(spark, tables, name):
    same(spark, tables, QUERIES[name], ORACLE_SQL[name])


def test_all_edges_take_part(spark, tmp_path):
    users, parts = range(1, 26), (1, 2)
    spark.createDataFrame([(u, u) for u in users], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(u, p) for u in users for p in parts], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERIES["cograph_edges"](spark, str(tmp_path)).count() == 300
    assert {tuple(r) for r in QUERIES["graph_degree"](spark, str(tmp_path)).collect()} == {(u, 24) for u in users}


def test_dense_numbers_of_many_values(spark):
    """The sort is sampled and coalesced: numbers must come from the very partitions that were counted."""
    rows = spark.range(0, 3_000_000, 1, 40).select((F.xxhash64("id") % 1_000_000).alias("k"))
    got = indexed(rows, "k")
    expected = rows.where("k IS NOT NULL").distinct().count()
    found = got.agg(F.count_distinct("position").alias("n"), F.min("position").alias("low"), F.max("position").alias("high")).first()
    assert tuple(found) == (expected, 0, expected - 1)
    values = got.orderBy("position").toPandas()["k"]
    assert values.is_monotonic_increasing


def test_no_pair_of_ratings_is_shuffled(spark):
    """Pairs of ratings are many more than ratings: they must be summed where they are made."""
    ratings = spark.createDataFrame([(u, f"i{u * k % 41:02}", float(u * k % 7)) for u in range(1, 30) for k in range(1, 20)], "user long, item string, stars double").distinct().groupBy("user", "item").agg(F.avg("stars").alias("stars"))
    pairs = pearson_pairs(ratings)
    assert "Exchange hashpartitioning(a" not in pairs._jdf.queryExecution().toString()
    x, y = (ratings.select("user", F.col("item").alias(c), F.col("stars").alias(f"s{c}")) for c in "ab")
    plain = x.join(y, "user").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("sa", "sb"), F.stddev_pop("sa") * F.stddev_pop("sb")).alias("r"))
    both = pairs.join(plain.withColumnRenamed("n", "m"), ["a", "b"], "full").toPandas()
    assert len(both) > 400 and (both["n"] == both["m"]).all()
    assert ((both["similarity"] - both["r"].fillna(0.0)).abs() < 1e-9).all()


def test_pairs_of_items_are_not_broadcast(spark):
    """Spark takes the size of the lists for that of the pairs made from them, and would send the pairs through the driver."""
    ratings = spark.createDataFrame([(u, i, float(u * i % 5)) for u in range(20) for i in range(10)], "user long, item long, stars double")
    near = neighbours(ratings, spark.createDataFrame([(1, 2), (3, 4)], "user long, item long"), min_corated=1)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [a#" in plan and "BroadcastHashJoin [a#" not in plan
    assert near.count() == 20
