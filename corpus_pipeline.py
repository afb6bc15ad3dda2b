"""The corpus pipeline: rejects, boilerplate and near copies go, the rest is mixed by source weights and packed.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the columns of ``documents``.
Null texts count as empty texts, null sources as a source (or site) of their own, repeated rows are treated alike, other
columns pass through, and empty tables give empty results. Stages with work in Python set the session's Arrow batches to
1,000 rows at most, so that executors hold few texts at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetric.llm import lines, mixing, packing, quality, simhash
from quillmetric.llm.work import Workspace, small_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to ``labels`` outside the held-out fold, scores 0.5 or more."""
    small_batches(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sources, but for the first place of each; n_chars follows the text."""
    cleaned = lines.drop_boilerplate(docs, Workspace(spark))
    if "n_chars" in docs.columns:
        shorter = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", shorter)
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    small_batches(spark)
    return simhash.one_of_each(docs, Workspace(spark))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix of sources takes them."""
    return mixing.repeat_documents(docs, Workspace(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    small_batches(spark)
    return packing.pack_documents(docs, Workspace(spark), release=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_copy_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the classifier, the fingerprints of near copies or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again by the next."""
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = work.table(docs, f"stage-{number}")
    return docs
