"""Failure ledgers: JSON lines from several optional paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetric.functions.text import strip

ENTRY = ("struct<timestamp:bigint,stepIdx:bigint,error:string,category:string,actionableFix:string,fix:string,"
         "command:string,args:struct<CommandLine:string>>")


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths that exist on whatever file system they name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).globStatus(p):
            found.append(path)
    return found


def read_ledgers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Entries of all ledgers; missing files, blank lines and malformed lines are skipped."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "value string").transform(parse_entries)
    return parse_entries(spark.read.text(found))


def parse_entries(lines: DataFrame, value: str = "value") -> DataFrame:
    keep = [c for c in lines.columns if c != value]
    raw = strip(F.col(value))
    good = lines.filter((raw != "") & F.try_parse_json(raw).isNotNull())
    return good.select(*keep, F.from_json(strip(F.col(value)), ENTRY).alias("e")).select(*keep, "e.*")
