"""Post analytics: weighted engagement, per-account baseline, outliers, top posts, feed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetric.functions.dates import day
from quillmetric.functions.text import clip_text, relevance, slug_join

OUTLIER_SIGMAS = 2.0
ACCOUNT = ("platform", "handle")

# Weight of each metric by platform.
WEIGHTS = {
    "x": {"likes": 1.0, "reposts": 2.0, "replies": 3.0, "quotes": 2.0, "bookmarks": 4.0},
    "youtube": {"views": 0.1, "likes": 1.0, "comments": 3.0},
    "linkedin": {"likes": 1.0, "comments": 3.0, "shares": 2.0},
}


def engagement_total(metrics: Column) -> Column:
    return F.aggregate(F.map_values(metrics), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0)))


def engagement_score(platform: Column, metrics: Column) -> Column:
    """Weighted sum for known platforms, plain sum of all metrics elsewhere."""
    out = engagement_total(metrics).cast("double")
    for name, weights in WEIGHTS.items():
        total = F.lit(0.0)
        for metric, weight in weights.items():
            total = total + F.coalesce(F.try_element_at(metrics, F.lit(metric)), F.lit(0)) * F.lit(weight)
        out = F.when(platform == name, total).otherwise(out)
    return out


def keep_since(posts: DataFrame, cutoff, date_col: str = "post_date") -> DataFrame:
    """Posts on or after the cutoff; undated posts stay."""
    when = F.col(date_col).cast("date")
    return posts.filter(when.isNull() | (when >= day(cutoff)))


def account_stats(posts: DataFrame, keys: Sequence[str] = ACCOUNT, score: str = "score") -> DataFrame:
    return posts.groupBy(*keys).agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
        F.count(F.lit(1)).alias("n_posts"))


def with_baseline(posts: DataFrame, keys: Sequence[str] = ACCOUNT, score: str = "score",
                  sigmas: float = OUTLIER_SIGMAS) -> DataFrame:
    """Attach mean, deviation, baseline multiple, z-score and outlier flag of each post's account.

    Statistics are aggregated first and joined back, so that an account with a large share of all
    posts is pre-aggregated on the map side and its join partition can be split; a window would
    send the whole account to one task.
    """
    joined = posts.join(account_stats(posts, keys, score), list(keys))
    s, mean, std = F.col(score), F.col("mean_score"), F.col("std_score")
    return (joined
            .withColumn("multiple", F.when(mean > 0, s / mean).otherwise(0.0))
            .withColumn("baseline", F.bround(F.col("multiple"), 1))
            .withColumn("z_score", F.when(std > 0, (s - mean) / std).otherwise(0.0))
            .withColumn("outlier", (std > 0) & (s > mean + F.lit(sigmas) * std)))


def top_posts(posts: DataFrame, n: int, keys: Sequence[str] = ACCOUNT, by: str = "total",
              position: str = "event_id") -> DataFrame:
    """Top n per account; ties keep arrival order. The rank filter is applied before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col(position))
    return posts.withColumn("rank_in_account", F.row_number().over(order)).filter(F.col("rank_in_account") <= n)


def performance_text(baseline: Column) -> Column:
    pct = F.bround((baseline - 1) * 100, 0).cast("bigint")
    sign = F.when(pct >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(baseline > 0, F.concat(sign, pct.cast("string"), F.lit("% vs baseline")))


def performance_up(baseline: Column) -> Column:
    return (baseline > 0) & (F.bround((baseline - 1) * 100, 0) > 0)


def outlier_reason(baseline: Column, z: Column) -> Column:
    lead = F.when(baseline > 0, F.concat(baseline.cast("string"), F.lit("×"))).otherwise(F.lit("well above"))
    return F.concat(lead, F.lit(" the account's typical engagement (z "),
                    F.bround(z, 1).cast("string"), F.lit(")"))


def feed_posts(posts: DataFrame) -> DataFrame:
    """Card table: one row per post of a baselined table with its position inside the account."""
    handle = F.regexp_replace("handle", "^@+", "")
    return posts.select(
        F.concat_ws("_", F.col("platform"), slug_join(handle), F.col("position").cast("string")).alias("id"),
        clip_text(F.col("text")).alias("text"), F.col("url"), handle.alias("handle"),
        F.coalesce(F.nullif(F.col("author"), F.lit("")), handle).alias("display_name"), F.col("platform"),
        F.map_concat(F.col("engagement"), F.create_map(F.lit("total"), F.col("total"))).alias("engagement"),
        F.col("total").alias("sort_value"), F.col("relevance"), F.col("post_date").alias("timestamp"),
        performance_text(F.col("baseline")).alias("performance"),
        F.when(performance_up(F.col("baseline")), "up").alias("performance_direction"),
        F.when(F.col("outlier"), F.bround("z_score", 1)).alias("z_score"),
        F.when(F.col("outlier"), outlier_reason(F.col("baseline"), F.col("z_score"))).alias("why"),
    )


def feed_meta(exploded: DataFrame) -> DataFrame:
    """Counts of an outer-exploded feed: accounts without posts still count as tracked."""
    has_post = F.col("post_key").isNotNull()
    # two steps, so that the distinct counts run over one row per account
    accounts = exploded.groupBy("platform", "handle").agg(
        F.count("post_key").alias("posts"), F.count_if(has_post & F.col("outlier")).alias("outliers"))
    return accounts.agg(
        F.count_distinct(F.when(F.col("posts") > 0, F.col("platform"))).alias("platform_count"),
        F.sum("posts").alias("post_count"), F.sum("outliers").alias("outlier_count"),
        F.count(F.lit(1)).alias("tracked_accounts"))


def attach_by_url(posts: DataFrame, extra: DataFrame, n: int, keys: Sequence[str] = ACCOUNT,
                  by: str = "total", position: str = "event_id") -> DataFrame:
    """Add a column set keyed by url to each account's top n posts; other posts get nulls.

    Posts without a url are never looked up. ``extra`` must hold one row per url.
    """
    chosen = top_posts(posts.filter(F.coalesce(F.col("url"), F.lit("")) != ""), n, keys, by, position)
    rest = [c for c in extra.columns if c != "url"]
    hits = chosen.select(position, "url").join(extra, "url").select(position, *rest)
    return posts.join(hits, position, "left")


def rescored(posts: DataFrame, pillars: Sequence[str]) -> DataFrame:
    """Relevance over text, description and transcript together."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("text", "description", "transcript") if c in posts.columns]
    return posts.withColumn("relevance", relevance(F.concat_ws(" ", *parts), pillars))


def unaccounted(posts: DataFrame, pillars: Sequence[str]) -> DataFrame:
    """Posts fetched one by one: score and relevance are set, account figures stay null."""
    return (posts.withColumn("score", engagement_score(F.col("platform"), F.col("engagement")))
            .withColumn("relevance", relevance(F.col("text"), pillars))
            .withColumn("baseline", F.lit(None).cast("double"))
            .withColumn("outlier", F.lit(None).cast("boolean")))
