"""Set similarity and rating correlation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import set_join
from quern.staging import Stages

#: A prime above all hashes of items.
PRIME = 2_147_483_647


def coefficients(n: int) -> list[tuple[int, int]]:
    """Multipliers and offsets of universal hash functions, by rule."""
    return [((7919 * i + 104_729) % 99_991 + 1, (15_485_863 * i + 32_452_843) % 99_989) for i in range(n)]


def _whole(sets: DataFrame) -> DataFrame:
    """id, hashes: a row per set, of ``sets`` (id, item) or of (id, items) with a row per id."""
    if "items" not in sets.columns:
        sets = sets.groupBy("id").agg(F.collect_set("item").alias("items"))
    return sets.where("id is not null and size(items) > 0").select("id", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))


def _similar(sets: DataFrame, threshold: float, label: str, bands: int = 0, band_keys: Callable | None = None) -> DataFrame:
    """a, b, similarity of sets with different items by ``similar_sets``, and of each class of equal sets with its other members."""
    stages = Stages(sets.sparkSession, label)
    integral = isinstance(sets.schema["id"].dataType, T.IntegralType)
    whole, kind = sets, sets.schema["id"].dataType
    if not integral:  # ids of other types are numbered in their order
        names = stages.write(sets.select("id").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("number")))
        whole = sets.join(names, "id").withColumn("id", F.col("number")).drop("number")
    whole = stages.write(_whole(whole).withColumn("id", F.col("id").cast("long")))  # read four times
    keys = stages.write(whole.mapInArrow(set_join.keys, "id long, key binary"))
    reps = keys.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("held")).where("held > 1")
    members = stages.write(keys.join(reps, "key").where("id <> rep").select("rep", F.col("id").alias("member")))
    stages.drop(keys)
    similar = set_join.similar_sets(whole, members, threshold, stages, bands, band_keys)
    stages.drop(whole)
    pairs = similar.unionByName(members.select(F.col("rep").alias("a"), F.col("member").alias("b"), F.lit(1.0).alias("similarity")))
    if integral:
        return pairs.select(F.col("a").cast(kind), F.col("b").cast(kind), "similarity")
    x, y = (names.select(F.col("number").alias(c), F.col("id").alias(f"id_{c}")) for c in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "similarity")


def jaccard_pairs(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """a < b, similarity: all pairs of different sets with Jaccard similarity ``threshold`` or more. ``sets``: id, item, distinct; or id, items, a row per id.

    Equal sets are joined once, under their smallest id; each other id of them comes as a pair with that id and
    similarity 1, so that copies cost a row each. The others are joined as ``set_join.similar_sets`` says.
    """
    return _similar(sets, threshold, "jaccard")


def minhash_signatures(sets: DataFrame, n_hashes: int = 200, prime: int = PRIME) -> DataFrame:
    """id, signature: an array of the smallest ``(a*x + b) % prime`` for each hash function. ``sets``: id, x (an integer)."""
    x = F.pmod(F.col("x"), F.lit(prime))
    least = [F.min((F.lit(a).cast("long") * x + F.lit(b).cast("long")) % F.lit(prime).cast("long")) for a, b in coefficients(n_hashes)]
    return sets.groupBy("id").agg(*(m.alias(f"m{i}") for i, m in enumerate(least))).select("id", F.array(*(F.col(f"m{i}") for i in range(n_hashes))).alias("signature"))


def lsh_pairs(sets: DataFrame, threshold: float = 0.5, n_hashes: int = 198, bands: int = 66) -> DataFrame:
    """The rows of ``jaccard_pairs`` whose sets agree in a band of their signatures, confirmed exactly.

    At a similarity of 0.5 a pair shares no band of three rows with probability 1.5e-4, at 0.6 with 2e-7.
    """
    rows = n_hashes // bands
    a, b = (np.array(c, np.int64)[:, None] for c in zip(*coefficients(rows * bands), strict=True))

    def band_keys(starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A key for each band of the signatures of ``minhash_signatures``, a row per set."""
        x = np.mod(hashes.view(np.int64), PRIME)
        least = np.empty((rows * bands, len(starts)), np.uint64)
        for k in range(rows * bands):
            least[k] = np.minimum.reduceat((a[k] * x + b[k]) % PRIME, starts)
        out = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(starts), axis=1)
        for k in range(rows):
            out = (out ^ least[k::rows]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.ascontiguousarray(out.T)

    return _similar(sets, threshold, "lsh", bands, band_keys)


def _place(column: Column, bounds: list, first: int = 0) -> Column:
    """The number of ``bounds`` (sorted) that ``column`` reaches, by halving."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(column < F.lit(bounds[m]), _place(column, bounds[:m], first)).otherwise(_place(column, bounds[m + 1 :], first + m + 1))


def _bounds(items: DataFrame, blocks: int) -> list:
    """At most ``blocks - 1`` values that part the distinct items about evenly, from 4096 of them by hash. They decide only where work is done."""
    some = sorted(r["item"] for r in items.select("item").distinct().orderBy(F.xxhash64("item")).limit(4096).collect())
    return sorted({some[len(some) * k // blocks] for k in range(1, blocks)} - set(some[:1])) if some else []


def pearson_pairs(ratings: DataFrame, min_corated: int = 1) -> DataFrame:
    """a < b, n, similarity of all item pairs with common raters. ``ratings``: user, item, stars, a row per user and item.

    Means are taken over common raters; a pair with fewer than ``min_corated`` of them, or without variance, has similarity 0.
    Items are cut into ranges. A user's sorted list goes once to each range that holds an item of it, from that item on,
    and all pairs whose smaller item lies in a range are made and summed in its task, so that no pair is shuffled.
    """
    spark = ratings.sparkSession
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = ratings.where("user is not null and item is not null")
    rated = known.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("item", "stars"))).alias("rated"))
    lists = Stages(spark, "pearson").write(rated.where(F.size("rated") > 1).select("rated"))
    bounds = _bounds(lists.select(F.explode("rated.item").alias("item")), blocks)
    placed = lists.withColumn("places", F.transform("rated", lambda r: _place(r["item"], bounds)))
    each = placed.select("rated", "places", F.explode(F.array_distinct("places")).alias("block"))
    first, after = F.array_position("places", F.col("block")).cast("int"), F.array_position(F.reverse("places"), F.col("block")).cast("int")
    size = F.size("rated")
    sent = each.select("block", (size + 2 - after - first).alias("own"), F.slice("rated", first, size).alias("rated")).repartition(blocks, "block")
    smaller = sent.select("block", "rated", F.posexplode(F.slice("rated", F.lit(1), F.col("own"))).alias("at", "one"))
    met = smaller.select("block", "one", F.explode(F.slice("rated", F.col("at") + 2, F.size("rated"))).alias("other"))
    both = met.select("block", F.col("one.item").alias("a"), F.col("other.item").alias("b"), F.col("one.stars").alias("x"), F.col("other.stars").alias("y")).where("a < b")
    moments = both.groupBy("block", "a", "b").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(e)).alias(c) for c, e in {"sx": "x", "sy": "y", "sxy": "x*y", "sxx": "x*x", "syy": "y*y"}.items()))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx, vy = (F.greatest(F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n"), F.lit(0.0)) for c in "xy")
    scale = F.sqrt(vx) * F.sqrt(vy)
    value = F.when((F.col("n") >= min_corated) & (scale > 1e-9), cov / scale).otherwise(F.lit(0.0))
    return moments.select("a", "b", "n", value.alias("similarity"))
