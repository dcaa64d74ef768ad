"""Recommendation: item-based collaborative filtering, boosted-tree regression, and their blend."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.operators.similarity import pearson_pairs


def neighbours(train: DataFrame, test: DataFrame, top_n: int = 15, min_corated: int = 13, non_negative: bool = False, with_lowest: bool = False, exclude_self: bool = False) -> DataFrame:
    """user, item, neighbour, similarity, stars: the items of the user that are nearest to the item of the test pair.

    Pairs without enough common raters have similarity 0; an item is its own neighbour with 1 if the user rated it.
    Order: similarity (to nine digits) downwards, then item. ``with_lowest`` adds the lowest one again.
    All item pairs are many more than the lists that they are made from, whose size Spark takes for theirs: they are never broadcast.
    """
    wanted = test.select("user", "item").distinct()
    rated = wanted.join(train.select("user", F.col("item").alias("neighbour"), "stars"), "user")
    if exclude_self:
        rated = rated.where("item <> neighbour")
    similar = F.when(F.col("item") == F.col("neighbour"), F.lit(1.0)).otherwise(F.coalesce("similarity", F.lit(0.0)))
    met = rated.withColumns({"a": F.least("item", "neighbour"), "b": F.greatest("item", "neighbour")})
    pairs = pearson_pairs(train, min_corated).select("a", "b", "similarity").hint("merge")
    scored = met.join(pairs, ["a", "b"], "left").select("user", "item", "neighbour", F.round(similar, 9).alias("similarity"), "stars")
    if non_negative:
        scored = scored.where("similarity >= 0")
    order = [F.desc("similarity"), "neighbour"]
    each = W.partitionBy("user", "item")
    ranked = scored.withColumn("rank", F.row_number().over(each.orderBy(*order)))
    if not with_lowest:
        chosen = ranked.where(F.col("rank") <= top_n)
    else:
        times = (F.col("rank") <= top_n).cast("int") + (F.col("rank") == F.col("n")).cast("int")
        chosen = ranked.withColumn("n", F.count(F.lit(1)).over(each)).withColumn("time", F.explode(F.array_repeat(F.lit(1), times)))
    return chosen.select("user", "item", "neighbour", "similarity", "stars")


def item_cf(train: DataFrame, test: DataFrame, cold_start: float = 0.0, **params) -> DataFrame:
    """user, item, prediction for the test pairs; ``params`` as for ``neighbours``.

    Weighted mean of the neighbours' stars; where it is 0 or undefined, the mean of the item's and the user's mean;
    where user or item is unknown, ``cold_start``. Ratings are one per user and item.
    """
    near = neighbours(train, test, **params)
    sums = near.groupBy("user", "item").agg(F.sum(F.col("similarity") * F.col("stars")).alias("num"), F.sum(F.abs("similarity")).alias("den"))
    users = train.groupBy("user").agg(F.avg("stars").alias("user_mean"))
    items = train.groupBy("item").agg(F.avg("stars").alias("item_mean"))
    joined = test.select("user", "item").distinct().join(users, "user", "left").join(items, "item", "left").join(sums, ["user", "item"], "left")
    known = F.col("user_mean").isNotNull() & F.col("item_mean").isNotNull()
    weighted = F.when((F.abs("num") > 1e-9) & (F.col("den") > 1e-9), F.col("num") / F.col("den"))
    return joined.select("user", "item", F.when(~known, F.lit(cold_start)).otherwise(F.coalesce(weighted, (F.col("user_mean") + F.col("item_mean")) / 2)).alias("prediction"))


def rating_features(pairs: DataFrame, items: DataFrame, users: DataFrame, feedback: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``pairs`` (user, item, perhaps stars) with the columns of items (key item), users (key user) and feedback (key user)."""
    out = pairs.join(items, "item", how).join(users, "user", how)
    return out.join(feedback, "user", how) if feedback is not None else out


def fit_boosted_trees(features: DataFrame, inputs: list[str], label: str = "stars", rounds: int = 500, rate: float = 0.1, subsample: float = 0.9, column_share: float = 0.9, depth: int = 6, seed: int = 1) -> PipelineModel:
    """A regression of ``label``; rows and (per node) columns are subsampled."""
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip")
    trees = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction", maxIter=rounds, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=str(column_share), maxDepth=depth, seed=seed)
    return Pipeline(stages=[assembler, trees]).fit(features)


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """user, item, prediction."""
    return model.transform(features).select("user", "item", "prediction")


def blend(collaborative: DataFrame, model: DataFrame, alpha: float = 1e-5) -> DataFrame:
    """user, item, prediction: ``alpha`` of the first and the rest of the second, for pairs that both have."""
    both = collaborative.withColumnRenamed("prediction", "cf").join(model.withColumnRenamed("prediction", "trees"), ["user", "item"])
    return both.select("user", "item", (F.lit(alpha) * F.col("cf") + F.lit(1 - alpha) * F.col("trees")).alias("prediction"))


def hybrid_cf(train: DataFrame, test: DataFrame) -> DataFrame:
    """The collaborative part of the hybrid: any common rater, no negative similarity, 30 neighbours and the lowest again."""
    return item_cf(train, test, top_n=30, min_corated=1, non_negative=True, with_lowest=True)


def rmse(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """rmse, n over the pairs of both."""
    both = predictions.join(truth, ["user", "item"])
    return both.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("stars"), 2))).alias("rmse"), F.count(F.lit(1)).alias("n"))
