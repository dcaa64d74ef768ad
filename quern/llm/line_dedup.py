"""Line deduplication by distinct-site spread, with DataFrame operations only.

A line that many sites carry is boilerplate. Lines are keyed by two 64-bit hashes; a count of occurrences
first sets aside lines that cannot reach the threshold, then a HyperLogLog sketch of sites per line hash is
built in each partition and merged by the aggregation. An estimate far from ``min_sites`` decides by itself; for
lines within ``band`` of it the sites are counted exactly. Of a boilerplate line the first occurrence (smallest
id, then place) stays unless ``keep_first`` is off, so that no text is lost as a whole; all others are cut.

Lines are split at ``\\n`` and compared without surrounding ASCII white space; blank lines are never
boilerplate. Nulls: a null text stays null, a null site is the site '', a null id sorts before all others.
Rows equal in id and text are treated alike; ties can't arise. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.staging import Stages

#: Sites from which a line is boilerplate, and the share of it within which an estimate is checked exactly.
MIN_SITES, BAND = 10, 0.5
#: Base-2 logarithm of a sketch's buckets: a relative error of 1.6 percent.
LG_K = 12


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, site, place, h1, h2 of every line that is not blank."""
    split = docs.select("doc_id", "key", "site", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    plain = split.select("doc_id", "key", "site", "place", F.btrim("line", F.lit(" \t\n\x0b\x0c\r")).alias("line")).where("line <> ''")
    return plain.select("doc_id", "key", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _candidates(docs: DataFrame, stages: Stages, min_sites: int) -> DataFrame:
    """The lines that occur ``min_sites`` times or more, written: sketches, exact counts and cuts all read them.

    What occurs often is counted first, with a map-side sum for each line, and written, so that the join with
    it has no aggregation behind it and a very common line's partition can be split.
    """
    often = stages.write(_lines(docs).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h1", "h2"))
    return stages.write(_lines(docs).join(often, ["h1", "h2"]))


def boilerplate(candidates: DataFrame, stages: Stages, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """h1, h2, first (doc_id, key, place) of the lines that ``min_sites`` sites or more carry, written."""
    sketched = stages.write(candidates.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min(F.struct("doc_id", "key", "place")).alias("first")))
    far = sketched.where((F.col("sites") > min_sites * (1 + band)) | (F.col("sites") < min_sites * (1 - band)))
    near = sketched.where((F.col("sites") <= min_sites * (1 + band)) & (F.col("sites") >= min_sites * (1 - band)))
    # Distinct pairs first, summed map-side: a line near the threshold has few sites, however often it occurs.
    pairs = candidates.groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).select("h1", "h2")
    exact = pairs.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
    sure = far.where(F.col("sites") >= min_sites).select("h1", "h2", "first")
    return stages.write(sure.unionByName(near.drop("sites").join(exact.where(F.col("sites") >= min_sites), ["h1", "h2"]).select("h1", "h2", "first")))


def dedup_lines(df: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per document: doc_id, text without its boilerplate lines, n_lines, n_removed."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.col(text_col).alias("text"))
    return _cleaned(docs, docs, min_sites, band, keep_first).select("doc_id", "text", "n_lines", "n_removed")


def clean_documents(df: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, keep_first: bool = True) -> DataFrame:
    """``df`` (with doc_id, text, source) with cleaned texts, n_chars (if there) following them; all columns stay."""
    names = {c: f"_quern_{c}" for c in df.columns if c not in ("doc_id", "text")}
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), "text")
    whole = df.select("doc_id", F.xxhash64("text").alias("key"), "text", *(F.col(c).alias(n) for c, n in names.items()))
    out = _cleaned(docs, whole, min_sites, band, keep_first)
    if "n_chars" in names:
        out = out.withColumn("_quern_n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("_quern_n_chars")).cast(df.schema["n_chars"].dataType))
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in df.columns))


def _cleaned(docs: DataFrame, whole: DataFrame, min_sites: int, band: float, keep_first: bool) -> DataFrame:
    """``whole`` (doc_id, key, text and more) without the boilerplate of ``docs`` (doc_id, key, site, text)."""
    stages = Stages(docs.sparkSession, "line-dedup")
    candidates = _candidates(docs, stages, min_sites)
    known = boilerplate(candidates, stages, min_sites, band)
    here = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.key") == F.col("key")) & (F.col("first.place") == F.col("place"))
    hits = candidates.join(known, ["h1", "h2"])
    if keep_first:
        hits = hits.where(~here)
    cut = hits.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_set("place").alias("cut"))
    joined = whole.join(cut, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").drop("d", "k")
    # The generator holds the split lines as a column, so that they are split once and not per line kept.
    held = joined.select("*", F.explode(F.array(F.split("text", "\n"))).alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cut"))
    rest = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    counted = held.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long"), "n_removed": F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).cast("long")})
    return counted.withColumn("text", F.when(F.col("cut").isNull(), F.col("text")).otherwise(rest)).drop("lines", "cut", "key")


def oracle_sql(min_sites: int = MIN_SITES) -> str:
    """The same over the table documents, for DuckDB (exact counts; rows equal in id and text as one)."""
    return rf"""
WITH split AS (SELECT doc_id, text, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
lines AS (SELECT doc_id, site, raw, place, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM split),
often AS (SELECT line, min(struct_pack(d := doc_id, p := place)) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {min_sites}),
marked AS (SELECT l.doc_id, l.place, l.raw, o.line IS NOT NULL AND NOT (o.first.d = l.doc_id AND o.first.p = l.place) AS cut FROM lines l LEFT JOIN often o ON l.line = o.line)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE NOT cut), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
