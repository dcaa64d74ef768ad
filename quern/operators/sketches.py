"""Stream sketches in batch form. A stream is a table of batch_id, seq, key (an integer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter and its hash functions.
BITS, BIT_HASHES = 69_997, 100
#: Hash functions of the distinct count and their prime modulus.
FM_HASHES, FM_PRIME = 100, 999_983


def key_number(column: str, prime: int = BITS) -> Column:
    """A string's UTF-8 bytes as one big number modulo ``prime``, by Horner's rule."""
    text = F.hex(F.encode(F.col(column), "UTF-8"))
    at = F.sequence(F.lit(0), F.octet_length(column) - 1)
    byte = lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return F.when(F.octet_length(column) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: (acc * 256 + byte(i)) % prime))


def multiplier(i: Column) -> Column:
    """The rule of the hash functions' multipliers."""
    return (F.lit(7919) * i + F.lit(104_729)) % F.lit(9999) + 1


def offset(i: Column) -> Column:
    return (F.lit(6007) * i + F.lit(15_013)) % F.lit(9999)


def hashed(keys: DataFrame, n_hashes: int, modulus: int) -> DataFrame:
    """``keys`` with fn and h = (a*key + b) mod modulus for each hash function."""
    each = keys.withColumn("fn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_hashes - 1).cast("long"))))
    return each.withColumn("h", (multiplier(F.col("fn")) * F.pmod("key", F.lit(modulus)) + offset(F.col("fn"))) % F.lit(modulus).cast("long"))


def bloom_rates(stream: DataFrame, bits: int = BITS, n_hashes: int = BIT_HASHES, cumulative: bool = False) -> DataFrame:
    """batch_id, n_new, probes, hits, fpr, false_elements, element_fpr: a batch against a filter of the batch before.

    ``fpr`` counts bit probes of keys that the filter did not see, ``element_fpr`` keys with all bits set; repeats
    count. A filter of nothing gives 0; a batch without new keys has null rates. ``cumulative``: the filter holds all
    batches before. Batches are numbered without gaps.
    """
    keys = stream.groupBy("batch_id", "key").agg(F.count(F.lit(1)).alias("n"))
    probes = hashed(keys, n_hashes, bits)
    if cumulative:
        first_bit = probes.groupBy("h").agg(F.min("batch_id").alias("since"))
        first_key = keys.groupBy("key").agg(F.min("batch_id").alias("seen"))
        fresh = probes.join(first_key, "key").where(F.col("seen") >= F.col("batch_id"))
        tested = fresh.join(first_bit, "h").withColumn("hit", (F.col("since") < F.col("batch_id")).cast("long"))
    else:
        before = keys.select((F.col("batch_id") + 1).alias("batch_id"), "key")
        set_bits = probes.select((F.col("batch_id") + 1).alias("batch_id"), "h").distinct().withColumn("hit", F.lit(1).cast("long"))
        fresh = hashed(keys.join(before, ["batch_id", "key"], "left_anti"), n_hashes, bits)
        tested = fresh.join(set_bits, ["batch_id", "h"], "left").withColumn("hit", F.coalesce("hit", F.lit(0).cast("long")))
    per_key = tested.groupBy("batch_id", "key").agg(F.max("n").alias("n"), F.sum("hit").alias("hit"))
    rates = per_key.groupBy("batch_id").agg(F.sum("n").alias("n_new"), F.sum(F.col("n") * F.col("hit")).alias("hits"), F.sum(F.when(F.col("hit") == n_hashes, F.col("n")).otherwise(0)).alias("false_elements"))
    every = keys.select("batch_id").distinct().join(rates, "batch_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return every.select("batch_id", zero("n_new"), (F.coalesce("n_new", F.lit(0).cast("long")) * n_hashes).alias("probes"), zero("hits"), F.try_divide("hits", F.col("n_new") * n_hashes).alias("fpr"), zero("false_elements"), F.try_divide("false_elements", "n_new").alias("element_fpr"))


def trailing_zeros(h: Column) -> Column:
    """Zero bits at the end; one for zero."""
    return F.when(h == 0, F.lit(1)).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("int")


def fm_estimates(stream: DataFrame, n_hashes: int = FM_HASHES, prime: int = FM_PRIME) -> DataFrame:
    """batch_id, n_stream, n_distinct, estimate, estimate_std per batch.

    Powers of the longest tails, one per function, are sorted; ``estimate_std`` is their median, ``estimate`` takes for even
    numbers the two places after the middle, as its model does. Both are cut to integers.
    """
    keys = stream.groupBy("batch_id", "key").agg(F.count(F.lit(1)).alias("n"))
    sizes = keys.groupBy("batch_id").agg(F.sum("n").alias("n_stream"), F.count(F.lit(1)).alias("n_distinct"))
    tails = hashed(keys, n_hashes, prime).groupBy("batch_id", "fn").agg(F.max(trailing_zeros(F.col("h"))).alias("r"))
    powers = tails.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.pow(F.lit(2.0), F.col("r")))).alias("p"))
    at = lambda k: F.get("p", F.lit(k))
    half = n_hashes // 2
    quirk = at(half) if n_hashes % 2 else (at(half) + at(min(half + 1, n_hashes - 1))) / 2
    median = at(half) if n_hashes % 2 else (at(half - 1) + at(half)) / 2
    return sizes.join(powers, "batch_id").select("batch_id", "n_stream", "n_distinct", F.floor(quirk).alias("estimate"), F.floor(median).alias("estimate_std"))


def distinct_sketch(df: DataFrame, group: str, key: str, error: float = 0.02) -> DataFrame:
    """group, estimate by HyperLogLog++."""
    return df.groupBy(group).agg(F.approx_count_distinct(key, error).alias("estimate"))


def bottom_k(stream: DataFrame, id_col: str, size: int = 100) -> DataFrame:
    """A uniform sample of fixed size: the rows with the smallest priorities, which are a fixed hash of the id. Heaps per partition, no state."""
    priority = (F.col(id_col) * F.lit(2_654_435_761) + F.lit(12_345)) % F.lit(4_294_967_291)
    return stream.withColumn("priority", priority).orderBy("priority", id_col).limit(size)
