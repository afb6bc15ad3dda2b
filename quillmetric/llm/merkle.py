"""Merkle manifest of a corpus: leaf digests, a tree per language, a tree over these, and every document's inclusion proof.

Nodes carry nested-interval labels: a node covers the leaf ranks ``lo`` to ``hi`` of its group. On one level the intervals of a group are
``FANOUT ** level`` wide (the last may be shorter), so a child's parent lies in a known bucket of the level above and contains its interval;
a join by bucket and containment, level by level from the top down, hands every node its way to the root. What is left of a parent's interval
without the child's belongs to the siblings: those that end before ``lo`` are to the left, those that begin after ``hi`` to the right.

Each level is one shuffle of an eighth of the rows of the level below; texts are read once and never shuffled.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetric.llm.work import Workspace

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before: string, after: string>>"
IS_TOP = "lo = 0 AND hi = n - 1"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of the values, each as its byte count, a colon and itself; ``-`` stands for null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return digest(F.concat(*parts))


def ranked(rows: DataFrame, order: list[str], work: Workspace) -> DataFrame:
    """``rank`` of every row within its ``grp`` (from 0, nulls first) and ``n``, the rows of the group.

    Ranges of the whole order are numbered one by one and then shifted, so a group of any size is spread over many tasks.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    parts = work.table(rows.repartitionByRange(F.col("grp").asc_nulls_first(), *keys).withColumn("part", F.spark_partition_id()), "ranges")
    # one row per range and group
    counts = parts.groupBy("grp", "part").agg(F.count("*").alias("here"))
    group = Window.partitionBy("grp")
    until = F.sum("here").over(group.orderBy("part"))
    bases = counts.select(F.col("grp").alias("_grp"), F.col("part").alias("_part"), F.sum("here").over(group).alias("n"),
                          (until - F.col("here")).alias("_base"))
    numbered = parts.withColumn("_at", F.row_number().over(Window.partitionBy("grp", "part").orderBy(*keys)) - 1)
    return (numbered.join(bases, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("part") == F.col("_part")))
            .withColumn("rank", F.col("_base") + F.col("_at")).drop("_grp", "_part", "part", "_base", "_at"))


def leaves_of(rows: DataFrame, order: list[str], work: Workspace) -> DataFrame:
    """The ranked rows as nodes of the lowest level; ``rows`` have a ``grp`` and a ``hash``."""
    nodes = ranked(rows, order, work).withColumnRenamed("rank", "lo").withColumn("hi", F.col("lo"))
    return work.table(nodes, "leaves")


def climb(leaves: DataFrame, work: Workspace) -> list[DataFrame]:
    """The levels of the trees over ``leaves(grp, n, lo, hi, hash)``, lowest first.

    Upper levels hold ``children``, the labels and digests of at most eight nodes. A group ends where one node is left.
    """
    levels, width = [leaves], 1
    most = leaves.agg(F.max("n")).first()[0] or 0
    while width < most:
        several = levels[-1].filter(F.col("n") > width)
        width *= FANOUT
        runs = several.groupBy("grp", "n", F.floor(F.col("lo") / width).alias("bucket")).agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "hash"))).alias("children"))
        nodes = runs.select("grp", "n", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"),
                            digest(F.array_join("children.hash", "")).alias("hash"), "children")
        levels.append(work.table(nodes, "level"))
    return levels


def subroots(levels: list[DataFrame]) -> DataFrame:
    """The last node of every group."""
    return reduce(DataFrame.unionByName, [nodes.filter(IS_TOP).select("grp", "hash") for nodes in levels])


def _side(outside) -> Column:
    return F.array_join(F.transform(F.filter("_children", outside), lambda c: c["hash"]), "")


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``steps``, the siblings beside their way up: first their own tree's, then those of ``tops``, their group's row.

    All other columns of ``tops(grp, steps, ...)`` are handed down as well.
    """
    carried = [c for c in tops.columns if c not in ("grp", "steps")]
    tops = tops.withColumnRenamed("grp", "_grp")
    known = None
    for height in range(len(levels) - 1, -1, -1):
        nodes = levels[height]
        now = nodes.filter(IS_TOP).join(tops, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")
        if known is not None:
            bucket = F.floor(F.col("lo") / FANOUT ** (height + 1))
            parents = known.select(F.col("grp").alias("_grp"), bucket.alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                                   F.col("children").alias("_children"), F.col("steps").alias("_steps"), *carried)
            contained = (F.col("grp").eqNullSafe(F.col("_grp")) & (bucket == F.col("_bucket"))
                         & (F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi")))
            beside = F.struct(_side(lambda c: c["hi"] < F.col("lo")).alias("before"), _side(lambda c: c["lo"] > F.col("hi")).alias("after"))
            inner = (nodes.filter(f"NOT ({IS_TOP})").join(parents, contained)
                     .withColumn("steps", F.concat(F.array(beside), F.col("_steps"))))
            now = now.unionByName(inner.select(*now.columns))
        known = now
    return known


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings beside its way give."""
    return F.aggregate(steps, leaf, lambda node, step: digest(F.concat(step["before"], node, step["after"])))


def proof(steps: Column) -> Column:
    """Digest of all siblings beside the way, level by level, left to right."""
    return digest(F.array_join(F.flatten(F.transform(steps, lambda s: F.array(s["before"], s["after"]))), ""))


def manifest(docs: DataFrame, work: Workspace) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs(doc_id, source, lang, n_chars, text)``.

    Documents whose id has a CRC-32 divisible by 3 are tampered with: A-Z of the text become lower case before the root is recomputed, so
    only those without such letters (or text) verify. A null in any field counts as absent, which is not the same as empty. Rows without a
    doc_id come first and are never tampered with; rows of one doc_id are ordered by their digest, and repeated rows are leaves of their own.
    A null lang is a group of its own. A lone leaf is its language's subroot, a lone subroot the root. No documents give no rows; other
    columns are ignored.
    """
    plain = [F.col(c) for c in FIELDS]
    tampered = [*plain[:-1], F.translate(plain[-1], ascii_uppercase, ascii_lowercase)]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    digests = docs.select(*FIELDS).select(
        "doc_id", F.col("lang").alias("grp"), leaf_digest(*plain).alias("hash"),
        F.when(chosen, leaf_digest(*tampered)).otherwise(leaf_digest(*plain)).alias("presented"))
    levels = climb(leaves_of(work.table(digests, "digests"), ["doc_id", "hash"], work), work)

    top_rows = subroots(levels).select(F.lit(0).alias("grp"), F.col("grp").alias("lang"), "hash")
    top_levels = climb(leaves_of(top_rows, ["lang"], work), work)
    roots = subroots(top_levels).select("grp", F.col("hash").alias("root"), F.array().cast(STEPS).alias("steps"))
    tops = descend(top_levels, roots).select(F.col("lang").alias("grp"), F.col("hash").alias("subroot"), "root", "steps")

    found = descend(levels, work.table(tops, "tops")).select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof(F.col("steps")).alias("proof_sha256"),
        folded(F.col("presented"), F.col("steps")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
