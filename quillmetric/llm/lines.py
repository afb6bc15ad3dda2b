"""Line dedup by site spread: lines that stand on many sites are boilerplate.

HyperLogLog sketches of the sites, one per line hash, merge by aggregation. Lines whose estimate is near the threshold get an
exact count of sites; the others are decided by the estimate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetric.llm.work import Workspace, small, text_or_empty

MIN_SITES = 10
MIN_CHARS = 16
SKETCH_LOG2 = 10
DEVIATIONS = 6
COUNTS = ("n_lines", "n_removed")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Row key, site, place and 128-bit hash of every line that is long enough to be judged; white space at its ends is ignored."""
    split = docs.select("_doc", "_text_key", "_site", F.posexplode(F.split("text", "\n")).alias("_at", "_line"))
    stripped = split.withColumn("_line", F.regexp_replace("_line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return (stripped.filter(F.length("_line") >= min_chars)
            .select("_doc", "_text_key", "_site", "_at", F.xxhash64("_line").alias("_h1"),
                    F.xxhash64(F.lit("second"), F.col("_line")).alias("_h2")))


def _keyed(docs: DataFrame) -> DataFrame:
    """Whole rows with their keys. Rows with equal keys are equal in all that decides: the same doc_id and text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_or_empty().alias("text"),
                       F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(text_or_empty()).alias("_text_key"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_site"))


def spread_lines(lines: DataFrame, work: Workspace, min_sites: int = MIN_SITES, log2: int = SKETCH_LOG2) -> DataFrame:
    """``_h1, _h2, _first``: the lines on at least ``min_sites`` different sites, with their first place (doc_id, line number)."""
    margin = max(1, math.ceil(DEVIATIONS * 1.04 / math.sqrt(2 ** log2) * min_sites))
    sketched = lines.groupBy("_h1", "_h2").agg(F.hll_sketch_agg("_site", F.lit(log2)).alias("_sites"), _first())
    judged = sketched.withColumn("_estimate", F.hll_sketch_estimate("_sites")).drop("_sites")
    likely = work.table(judged.filter(F.col("_estimate") >= min_sites - margin), "likely-lines")
    near = likely.filter(F.col("_estimate") <= min_sites + margin).select("_h1", "_h2")
    exact = (lines.join(small(near), ["_h1", "_h2"], "left_semi").select("_h1", "_h2", "_site").distinct()
             .groupBy("_h1", "_h2").count().filter(F.col("count") >= min_sites).select("_h1", "_h2"))
    certain = likely.filter(F.col("_estimate") > min_sites + margin)
    return certain.select("_h1", "_h2", "_first").unionByName(
        likely.join(exact, ["_h1", "_h2"], "left_semi").select("_h1", "_h2", "_first"))


def _first() -> Column:
    return F.min(F.struct(F.col("_doc"), F.col("_text_key"), F.col("_at"))).alias("_first")


def drop_boilerplate(docs: DataFrame, work: Workspace, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` less its boilerplate lines, and ``n_lines``, ``n_removed``.

    A line of at least ``min_chars`` characters that stands on ``min_sites`` different sources or more is removed from
    all documents but the first place that has it (smallest doc_id, then line), so that no passage is lost from the corpus.
    Null and empty sources are one site; a null text stays null and counts as one empty line; a text all of whose
    lines go becomes empty. Repeated rows are treated alike. Other columns stay as they are, but for older columns
    with the names of the two counts, which are replaced.
    """
    keyed = _keyed(docs)
    lines = _lines(keyed, min_chars)
    spread = small(work.table(spread_lines(lines, work, min_sites), "spread-lines"))
    here = F.struct(F.col("_doc"), F.col("_text_key"), F.col("_at"))
    repeated = lines.join(spread, ["_h1", "_h2"]).filter(~here.eqNullSafe(F.col("_first")))
    # distinct places: equal rows of the input share them
    marks = repeated.groupBy("_doc", "_text_key").agg(F.collect_set("_at").alias("_gone"))
    marks = small(work.table(marks, "marked-lines"))
    joined = keyed.join(marks, keyed["_doc"].eqNullSafe(marks["_doc"]) & (keyed["_text_key"] == marks["_text_key"]), "left").select(
        keyed["*"], marks["_gone"])
    own_text = F.col("_row").getField("text")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    cleaned = F.when(F.col("_gone").isNull(), own_text).otherwise(kept)
    columns = [(cleaned if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns if c not in COUNTS]
    return joined.select(*columns, F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
                         F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
