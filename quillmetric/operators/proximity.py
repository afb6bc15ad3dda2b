"""Warmth of contacts: path scores, diminishing-returns aggregate, access degree and tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetric.functions.text import compute_once

# Points, category floors, path weights and breadth bonus.
ANCHOR, PEER = 75, 45


def path_score(paths: DataFrame) -> DataFrame:
    """total_q and category of each path from its seven flags."""
    tenure = F.when(F.col("overlapping_tenure"), 40).when(F.col("shared_company"), 20).otherwise(0)
    authority = F.when(F.col("former_manager"), 25).when(F.col("staff_or_lead"), 15).otherwise(0)
    rest = (F.when(F.col("shared_cohort"), 20).otherwise(0) + F.when(F.col("domain_peer"), 10).otherwise(0)
            + F.when(F.col("recently_active"), 5).otherwise(0))
    out = paths.withColumn("total_q", F.least(F.lit(100), tenure + authority + rest))
    return out.withColumn("category", F.when(F.col("total_q") >= ANCHOR, "anchor").when(
        F.col("total_q") >= PEER, "domain_peer").otherwise("low_signal"))


def breadth_bonus(count: Column) -> Column:
    return F.when(count >= 10, 10).when(count >= 6, 6).when(count >= 4, 3).otherwise(0)


def aggregate_paths(paths: DataFrame, contact: str, path_id: str, name: str) -> DataFrame:
    """Per contact: paths, best path name and the three best scores.

    Only three rows per contact pass the rank limit, which also runs before the shuffle; the count is
    a plain aggregate. No list of a contact's paths is ever built.
    """
    order = Window.partitionBy(contact).orderBy(F.desc("total_q"), F.col(path_id))
    top = paths.withColumn("_r", F.row_number().over(order)).filter("_r <= 3").groupBy(contact).agg(
        *[F.max(F.when(F.col("_r") == i, F.col("total_q"))).alias(f"q{i}") for i in (1, 2, 3)],
        F.max(F.when(F.col("_r") == 1, F.col(name))).alias("best_name"))
    return top.join(paths.groupBy(contact).agg(F.count(F.lit(1)).alias("n_paths")), contact)


def proximity(q1: Column, q2: Column, q3: Column, n_paths: Column, total: Column) -> Column:
    """One path counts fully, two 75/25, more 70/20/10, plus the breadth bonus; 0 to 100."""
    bonus = breadth_bonus(F.greatest(F.coalesce(total, F.lit(0)), n_paths))
    weighted = (F.when(n_paths == 1, q1.cast("double")).when(n_paths == 2, 0.75 * q1 + 0.25 * q2)
                .otherwise(0.7 * q1 + 0.2 * q2 + 0.1 * q3) + bonus)
    return F.when(F.coalesce(n_paths, F.lit(0)) == 0, 0).otherwise(F.least(F.lit(100), F.bround(weighted, 0).cast("int")))


def assess(contacts: DataFrame) -> DataFrame:
    """warmth_degree 7-1, tier, action and rationale of contacts with degree, proximity, best_name and access flags.

    Action and rationale are short codes, with the name, score or channel they depend on after a colon. Needs degree,
    is_friend, is_teammate, open_profile, verified_email, proximity, best_name.
    """
    first, second = F.col("degree") == "1st", F.col("degree") == "2nd"
    score, named = F.col("proximity"), F.col("best_name")
    channel = F.when(F.col("open_profile"), "open_profile").otherwise("email")

    def code(name: str, value: Column | None = None) -> Column:
        return F.lit(name) if value is None else F.concat(F.lit(name + ": "), F.coalesce(value.cast("string"), F.lit("-")))

    rules = [
        (F.col("is_friend") | (first & F.col("is_teammate")), 7, "WARM", code("personal_message"), code("knows_personally")),
        (first, 6, "WARM", code("direct_message"), code("connected")),
        (second & (score >= ANCHOR), 6, "WARM", code("ask_introduction", named), code("anchor_mutual", named)),
        (second & (score >= PEER), 5, "BRIDGE", code("note_naming", named), code("peer_mutuals", score)),
        (second, 4, "BRIDGE", code("note_on_work"), code("loose_mutuals", score)),
        (F.col("open_profile") | F.col("verified_email"), 3, "COLD", code("sequence_by", channel), code("direct_path", channel)),
        (F.col("degree").isin("3rd+", "Unknown"), 2, "FROZEN", code("hold"), code("no_path")),
    ]
    verdict = _verdict(1, "FROZEN", code("archive"), code("dead_end"))
    for test, *parts in reversed(rules):
        verdict = F.when(test, _verdict(*parts)).otherwise(verdict)
    return compute_once(contacts, _verdict=verdict).select("*", "_verdict.*").drop("_verdict")


def _verdict(degree: int, tier: str, action: Column, rationale: Column) -> Column:
    return F.struct(F.lit(degree).alias("warmth_degree"), F.lit(tier).alias("contact_tier"), action.alias("action"), rationale.alias("rationale"))
