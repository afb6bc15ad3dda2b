"""Data-quality jobs: ranges, configuration tables, blocked pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetric.functions.text import literal_array
from quillmetric.functions.urls import block_reason


def range_violations(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One row: how many values of each column lie outside its limits."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(~F.col(c).between(low, high)).alias(f"bad_{c}") for c, (low, high) in limits.items()])


def config_violations(entries: DataFrame, key: str, entry: str, required: Sequence[str], optional: Sequence[str],
                      allowed: Mapping[str, Sequence[str]], unique: str) -> DataFrame:
    """(key, problem) for missing and unknown keys, values outside their vocabulary and repeated names.

    Repeats are found by counting names first, so a name used very often stays one row until the
    entries are flagged.
    """
    keys = F.map_keys(entry)
    missing = F.transform(F.array_except(literal_array(required), keys), lambda k: F.concat(F.lit("missing "), k))
    extra = F.transform(F.array_except(keys, literal_array([*required, *optional])),
                        lambda k: F.concat(F.lit("unknown key "), k))
    wrong = F.array_compact(F.array(*[
        F.when(~F.try_element_at(entry, F.lit(c)).isin(*values),
               F.concat(F.lit(f"bad {c} "), F.try_element_at(entry, F.lit(c)))) for c, values in allowed.items()]))
    named = entries.withColumn("_name", F.try_element_at(entry, F.lit(unique)))
    repeated = named.groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) & F.col("_name").isNotNull())
    doubled = named.join(repeated, "_name", "left_semi").select(key, F.lit(f"duplicate {unique}").alias("problem"))
    return entries.select(key, F.explode(F.concat(missing, extra, wrong)).alias("problem")).unionByName(doubled)


def blocked_pages(pages: DataFrame, url: str, title: str) -> DataFrame:
    """Blocked page counts by kind of reason."""
    reason = block_reason(F.col(url), F.col(title))
    kind = F.when(reason.startswith("blocked page title"), "title").when(reason.isNotNull(), "path")
    return pages.select(F.coalesce(kind, F.lit("ok")).alias("block_kind")).groupBy("block_kind").agg(
        F.count(F.lit(1)).alias("pages"))
