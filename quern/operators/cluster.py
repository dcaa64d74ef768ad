"""Out-of-core clustering by summaries (count, sum and sum of squares per dimension) over chunks of points.

Points stay in tables; the driver holds summaries of clusters, whose number the parameters bound. Retained points
are carried from chunk to chunk.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.staging import Stages

Summary = tuple[int, list[float], list[float]]


def moments(points: DataFrame, cluster_col: str) -> DataFrame:
    """cluster, dim, n, sum, sumsq of ``features`` (an array)."""
    each = points.select(F.col(cluster_col).alias("cluster"), F.posexplode("features").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return each.groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))


def centroids(stats: DataFrame) -> DataFrame:
    """cluster, dim, mean, std (of the population) from ``moments``."""
    mean = F.col("sum") / F.col("n")
    return stats.select("cluster", "dim", mean.alias("mean"), F.sqrt(F.greatest(F.col("sumsq") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def mahalanobis_assign(points: DataFrame, centres: DataFrame, gate: float = 2.0) -> DataFrame:
    """point_id, cluster, distance: the nearest centre within ``gate`` times the root of the dimension, else null. Ties go to the smaller cluster.

    ``centres``: cluster, dim, mean, std. Dimensions without spread don't count. The centres are packed to one array row,
    a broadcast of clusters times dimensions, so a point is compared in its own row and nothing is shuffled.
    """
    packed = centres.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("c")).agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("centres"))

    def apart(x, c):
        terms = F.zip_with(x, c, lambda v, k: F.when(k["std"] > 0, F.pow((v.cast("double") - k["mean"]) / k["std"], 2)).otherwise(F.lit(0.0)))
        return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))

    near = F.array_min(F.transform("centres", lambda c: F.struct(apart(F.col("features"), c["c"]).alias("distance"), c["cluster"].alias("cluster"))))
    scored = points.crossJoin(F.broadcast(packed)).select("point_id", near.alias("near"), F.size("features").alias("d"))
    inside = F.col("near.distance") < F.lit(gate) * F.sqrt(F.col("d"))
    return scored.select("point_id", F.when(inside, F.col("near.cluster")).alias("cluster"), F.col("near.distance").alias("distance"))


def _kmeans(points: DataFrame, k: int, seed: int) -> DataFrame:
    """``points`` with ``c``, a cluster number."""
    data = points.withColumn("_v", array_to_vector(F.transform("features", lambda x: x.cast("double"))))
    return KMeans(k=max(2, k), seed=seed, featuresCol="_v", predictionCol="c", maxIter=20).fit(data).transform(data).drop("_v")


def _summaries(points: DataFrame) -> dict[int, Summary]:
    """c -> summary; a row per cluster reaches the driver."""
    rows = moments(points, "c").groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "sum", "sumsq"))).alias("m")).collect()
    return {r["cluster"]: (r["n"], [m["sum"] for m in r["m"]], [m["sumsq"] for m in r["m"]]) for r in rows}


def _spread(s: Summary) -> tuple[list[float], list[float]]:
    n, sums, squares = s
    mean = [x / n for x in sums]
    return mean, [math.sqrt(max(q / n - m * m, 0.0)) for q, m in zip(squares, mean, strict=True)]


def _distance(a: Summary, b: Summary) -> float:
    """From the centre of ``a`` to that of ``b`` in units of the spread of ``b``."""
    (m, _), (c, sd) = _spread(a), _spread(b)
    return math.sqrt(sum(((x - y) / s) ** 2 for x, y, s in zip(m, c, sd, strict=True) if s > 0))


def _added(a: Summary, b: Summary) -> Summary:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)], [x + y for x, y in zip(a[2], b[2], strict=True)]


def _centres(spark, sets: dict[int, Summary]) -> DataFrame:
    rows = [(c, d, m, s) for c, x in sets.items() for d, (m, s) in enumerate(zip(*_spread(x), strict=True))]
    return spark.createDataFrame(rows, "cluster int, dim int, mean double, std double")


ROUNDS = "round int, ds_points long, cs_clusters long, cs_points long, rs_points long"


def bfr(points: DataFrame, k: int, chunks: int = 5, seed: int = 11_111, gate: float = 2.0, merged_label: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rounds, assignments): round, ds_points, cs_clusters, cs_points, rs_points; and point_id, cluster.

    ``points``: point_id, features. Points of a compression set get the cluster it is merged into at the end, or -1
    (always -1 without ``merged_label``); retained points get -1 too. An empty table gives empty results.
    """
    spark = points.sparkSession
    stages = Stages(spark, "bfr")
    rows = stages.write(points.select("point_id", "features").withColumn("chunk", F.pmod(F.xxhash64("point_id", F.lit(seed)), F.lit(chunks)).cast("int")))
    one = rows.select("features").first()
    if one is None:
        return spark.createDataFrame([], ROUNDS), rows.select("point_id", F.lit(-1).alias("cluster"))
    dim = len(one[0])
    limit = gate * math.sqrt(dim)
    ds: dict[int, Summary] = {}
    cs: dict[int, Summary] = {}
    parent: dict[int, int] = {}
    next_cs = 0
    placed: list[DataFrame] = []  # point_id, kind, c
    report = []
    retained = rows.limit(0).select("point_id", "features")

    def cluster_retained(rs: DataFrame) -> DataFrame:
        """Clusters of several points become compression sets; returns what is left."""
        nonlocal next_cs
        n = rs.count()
        want = 5 * k if n >= 5 * k else n // 2
        if want < 2:
            return rs
        grouped = stages.write(_kmeans(rs, want, seed))
        sizes = grouped.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        several = grouped.join(sizes.where("n > 1").select("c"), "c", "left_semi")
        found = _summaries(several)
        number = {c: next_cs + i for i, c in enumerate(sorted(found))}
        next_cs += len(found)
        cs.update({number[c]: s for c, s in found.items()})
        if number:
            names = spark.createDataFrame(list(number.items()), "c int, cs int")
            placed.append(stages.write(several.join(F.broadcast(names), "c").select("point_id", F.lit("cs").alias("kind"), F.col("cs").alias("c"))))
        return stages.write(grouped.join(sizes.where("n = 1").select("c"), "c", "left_semi").select("point_id", "features"))

    def merge_cs() -> None:
        """Each set at most once per round."""
        used: set[int] = set()
        for a in sorted(cs):
            for b in sorted(cs):
                if a < b and a in cs and b in cs and not {a, b} & used and _distance(cs[a], cs[b]) < limit:
                    cs[a] = _added(cs[a], cs.pop(b))
                    parent[b] = a
                    used |= {a, b}

    for chunk in range(chunks):
        fresh = rows.where(F.col("chunk") == chunk).select("point_id", "features")
        if chunk == 0:
            rough = stages.write(_kmeans(fresh, 5 * k, seed))
            sizes = rough.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
            retained = stages.write(rough.join(sizes.where("n = 1").select("c"), "c", "left_semi").select("point_id", "features"))
            rest = rough.join(sizes.where("n > 1").select("c"), "c", "left_semi").select("point_id", "features")
            first = stages.write(_kmeans(rest, k, seed))
            ds = _summaries(first)
            placed.append(stages.write(first.select("point_id", F.lit("ds").alias("kind"), "c")))
        else:
            left = fresh
            for kind, sets in (("ds", ds), ("cs", cs)):
                if sets:
                    near = mahalanobis_assign(left, _centres(spark, sets), gate)
                    hit = stages.write(left.join(near.where("cluster is not null").select("point_id", F.col("cluster").alias("c")), "point_id"))
                    for c, s in _summaries(hit).items():
                        sets[c] = _added(sets[c], s)
                    placed.append(hit.select("point_id", F.lit(kind).alias("kind"), "c"))
                    left = stages.write(left.join(hit.select("point_id"), "point_id", "left_anti"))
            retained = retained.unionByName(left)
        retained = cluster_retained(retained)
        if chunk:
            merge_cs()
        report.append((chunk + 1, sum(s[0] for s in ds.values()), len(cs), sum(s[0] for s in cs.values()), retained.count()))

    final = {c: next((d for d in sorted(ds) if _distance(s, ds[d]) < limit), -1) for c, s in cs.items()}

    def root(c: int) -> int:
        while c in parent:
            c = parent[c]
        return c

    goal = [(c, final[root(c)] if merged_label else -1) for c in range(next_cs)]
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    of_cs = spark.createDataFrame(goal, "c int, goal int")
    named = every.where("kind = 'cs'").join(F.broadcast(of_cs), "c").select("point_id", F.col("goal").alias("cluster"))
    out = every.where("kind = 'ds'").select("point_id", F.col("c").alias("cluster")).unionByName(named).unionByName(retained.select("point_id", F.lit(-1).alias("cluster")))
    return spark.createDataFrame(report, ROUNDS), out
