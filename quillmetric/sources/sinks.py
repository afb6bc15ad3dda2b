"""Sinks: feed and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetric.sources.ledger import existing


def write_feed(posts: DataFrame, meta: DataFrame, out: str) -> dict[str, str]:
    """Replace the posts and meta tables of a feed. The ideas table is separate and never rewritten."""
    paths = {name: f"{out.rstrip('/')}/{name}" for name in ("posts", "meta", "ideas")}
    posts.write.mode("overwrite").partitionBy("platform").parquet(paths["posts"])
    meta.write.mode("overwrite").parquet(paths["meta"])
    return paths


def read_ideas(spark: SparkSession, out: str, schema: str = "id string, text string") -> DataFrame:
    path = f"{out.rstrip('/')}/ideas"
    if not existing(spark, [path]):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_findings(findings: DataFrame, out: str) -> bool:
    """Write findings by rule and say whether any is an error (read back from what was written)."""
    findings.write.mode("overwrite").partitionBy("rule").parquet(out)
    done = findings.sparkSession.read.parquet(out)
    row = done.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("failed")).first()
    return bool(row["failed"])
