"""Writers of reports. Rows are formatted in Spark; one file results where a report is one file by nature."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, one_file: bool = True) -> None:
    """One JSON object per row."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """value: each row as a JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A header and comma-joined rows."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def itemset_report(itemsets: DataFrame, items_col: str = "items") -> DataFrame:
    """size, line: itemsets (arrays) as ``('a', 'b')``, those of a size joined by commas in order, quoted for all sizes."""
    shown = F.concat(F.lit("("), F.array_join(F.transform(F.array_sort(items_col), lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", "), F.lit(")"))
    each = itemsets.select(F.size(items_col).alias("size"), F.array_sort(items_col).alias("k"), shown.alias("s")).distinct()
    lines = each.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("all"))
    return lines.select("size", F.array_join(F.col("all.s"), ",").alias("line")).orderBy("size")


def write_itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """The sections ``Candidates:`` and ``Frequent Itemsets:``, a blank line after each size."""
    spark = candidates.sparkSession
    parts = []
    for k, (title, sets) in enumerate((("Candidates:", candidates), ("Frequent Itemsets:", frequent))):
        parts.append(spark.createDataFrame([(k, 0, title)], "section int, size int, line string"))
        parts.append(itemset_report(sets).select(F.lit(k).alias("section"), "size", F.concat("line", F.lit("\n")).alias("line")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows.orderBy("section", "size").select("line").coalesce(1).write.mode("overwrite").text(path)


def community_lines(communities: DataFrame, members_col: str = "members") -> DataFrame:
    """line: ``'a', 'b'`` per community, by size, then members."""
    members = F.array_sort(members_col)
    text = F.array_join(F.transform(members, lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", ")
    return communities.select(F.size(members).alias("n"), members.alias("m"), text.alias("line")).orderBy("n", "m").select("line")


def betweenness_lines(edges: DataFrame) -> DataFrame:
    """line: ``('a', 'b'),1.0``, by value downwards, then the edge. ``edges``: src, dst, betweenness."""
    text = F.concat(F.lit("('"), F.col("src").cast("string"), F.lit("', '"), F.col("dst").cast("string"), F.lit("'),"), F.col("betweenness").cast("string"))
    return edges.orderBy(F.desc("betweenness"), "src", "dst").select(text.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A text file of the one column."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def bfr_report(rounds: DataFrame, assignments: DataFrame) -> DataFrame:
    """line: a progress line per round, then ``id,cluster`` lines."""
    head = rounds.select(F.lit(0).alias("section"), F.col("round").cast("long").alias("k"), F.concat(F.lit("Round "), F.col("round"), F.lit(": "), F.concat_ws(",", "ds_points", "cs_clusters", "cs_points", "rs_points")).alias("line"))
    body = assignments.select(F.lit(1).alias("section"), F.col("point_id").alias("k"), F.concat_ws(",", "point_id", "cluster").alias("line"))
    return head.unionByName(body).orderBy("section", "k").select("line")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
