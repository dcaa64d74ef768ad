"""The corpus pipeline: quality rules, line deduplication, near-deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Labels and benchmark
come from ``sf_dir``. The first four return the columns of documents; the last the packed pieces.

Rows are judged each, whatever their ids: rows that repeat an id, or have none, are documents of their own. A null text
has no words and goes with the quality rules. Of near duplicates the smallest id stays, null after all others; of rows equal
in it, one. Empty tables give empty results; other columns pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, line_dedup, near_dedup, packing, quality, registry
from quern.staging import Stages

#: Percent of shared shingles from which documents are near duplicates in the pipeline.
NEAR_PERCENT = 80
_ROW = "_quern_row"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the certified cutoffs reject."""
    return quality.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without boilerplate lines but for the first occurrence of each; n_chars follows the text."""
    return line_dedup.clean_documents(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id. Rows get a number each, fixed by writing it."""
    keyed = Stages(spark, "pipeline-near").write(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    found = near_dedup.near_duplicates(keyed, percent=NEAR_PERCENT, shape=near_dedup.AT_80, id_col=_ROW)
    groups = found.select(F.col("doc_id").alias(_ROW), "component_id").join(found.where("not kept").select("component_id").distinct(), "component_id")
    ranked = groups.join(keyed.select(_ROW, F.col("doc_id").alias("id")), _ROW).select("component_id", F.struct(F.col("id").isNull().alias("unknown"), "id", _ROW).alias("rank"))
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("first"))
    gone = ranked.join(first, "component_id").where(F.col(f"rank.{_ROW}") != F.col(f"first.{_ROW}")).select(F.col(f"rank.{_ROW}").alias(_ROW))
    return keyed.join(gone, _ROW, "left_anti").select(docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.best_fit_packing(docs, registry.PACKING_ENCODER, end_id=2, capacity=1024)


STAGES = [("quality", keep_quality), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("decontamination", decontaminate_documents), ("packing", pack_documents)]

#: Certified cutoffs and greedy packing are no SQL; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = Stages(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = stages.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
