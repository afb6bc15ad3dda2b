"""Registered queries: posts, accounts and feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetric.functions import dates, text, urls
from quillmetric.operators import engagement as eng
from quillmetric.plans.registry import query
from quillmetric.tables import POSTS, table, with_sql

SINCE = "2024-01-08"
SCORE_SQL = """CASE platform
  WHEN 'x' THEN CAST(likes + 2*(k%7) + 3*(k%5) + 2*(k%3) + 4*(k%2) AS DOUBLE)
  WHEN 'youtube' THEN (k*10) * 0.1::DOUBLE + likes + 3*(k%11)
  WHEN 'linkedin' THEN CAST(likes + 3*(k%11) + 2*(k%7) AS DOUBLE)
  ELSE CAST(likes + k AS DOUBLE) END"""
TOTAL_SQL = """CASE platform
  WHEN 'x' THEN likes + k%7 + k%5 + k%3 + k%2 + k*10
  WHEN 'youtube' THEN k*10 + likes + k%11
  WHEN 'linkedin' THEN likes + k%11 + k%7
  ELSE likes + k END"""
SCORED_SQL = f"{with_sql(POSTS)}, scored AS (SELECT *, {SCORE_SQL} AS score, CAST({TOTAL_SQL} AS BIGINT) AS total FROM posts)"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts with a metric map, score and total."""
    df = POSTS.spark(spark, sf_dir)
    k, likes = F.col("k"), F.col("likes")

    def metrics(**values):
        pairs = []
        for name, value in values.items():
            pairs += [F.lit(name), value.cast("bigint")]
        return F.create_map(*pairs)

    engagement = (
        F.when(F.col("platform") == "x", metrics(
            likes=likes, reposts=k % 7, replies=k % 5, quotes=k % 3, bookmarks=k % 2, views=k * 10))
        .when(F.col("platform") == "youtube", metrics(views=k * 10, likes=likes, comments=k % 11))
        .when(F.col("platform") == "linkedin", metrics(likes=likes, comments=k % 11, shares=k % 7))
        .otherwise(metrics(likes=likes, extra=k)))
    df = df.withColumn("engagement", engagement)
    return (df.withColumn("score", eng.engagement_score(F.col("platform"), F.col("engagement")))
            .withColumn("total", eng.engagement_total(F.col("engagement"))))


@query("x_engage", f"{SCORED_SQL} SELECT event_id, platform, round(score, 4) AS score FROM scored")
def x_engage(spark, sf_dir):
    return posts(spark, sf_dir).select("event_id", "platform", F.round("score", 4).alias("score"))


@query("a_engtotal", f"{SCORED_SQL} SELECT event_id, total AS sort_value FROM scored")
def a_engtotal(spark, sf_dir):
    return posts(spark, sf_dir).select("event_id", F.col("total").alias("sort_value"))


@query("f_since", f"""{with_sql(POSTS)} SELECT event_id, handle, post_date FROM posts
  WHERE post_date IS NULL OR post_date >= '{SINCE}'""")
def f_since(spark, sf_dir):
    return eng.keep_since(POSTS.spark(spark, sf_dir), SINCE).select("event_id", "handle", "post_date")


@query("f_window", f"""{with_sql(POSTS)}, c AS (SELECT event_id, post_date,
    CASE WHEN k % 10 = 0 THEN 'x' ELSE CAST(k * 2 - 20 AS VARCHAR) END AS raw_days,
    CASE WHEN k % 4 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(k % 29 AS INT) END AS stored FROM posts),
  d AS (SELECT *, greatest(least(coalesce(try_cast(raw_days AS INT), 7), 90), 1) AS days FROM c)
  SELECT event_id, days, strftime(greatest(coalesce(stored, DATE '2024-01-31' - days), DATE '2024-01-31' - days),
    '%Y-%m-%d') AS cutoff FROM d
  WHERE post_date IS NULL OR CAST(post_date AS DATE)
    >= greatest(coalesce(stored, DATE '2024-01-31' - days), DATE '2024-01-31' - days)""")
def f_window(spark, sf_dir):
    df = POSTS.spark(spark, sf_dir).selectExpr(
        "event_id", "post_date", "CASE WHEN k % 10 = 0 THEN 'x' ELSE CAST(k * 2 - 20 AS STRING) END AS raw_days",
        "CASE WHEN k % 4 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(k % 29 AS INT) END AS stored")
    df = df.withColumn("days", dates.window_days(F.col("raw_days")))
    df = df.withColumn("cutoff", dates.effective_since(F.col("stored"), "2024-01-31", F.col("days")))
    return eng.keep_since(df, F.col("cutoff")).select("event_id", "days", F.col("cutoff").cast("string").alias("cutoff"))


BASE_SQL = f"""{SCORED_SQL}, kept AS (SELECT * FROM scored WHERE post_date IS NULL OR post_date >= '{SINCE}'),
  stats AS (SELECT platform, handle, avg(score) AS mean_score, stddev_pop(score) AS std_score FROM kept GROUP BY ALL),
  based AS (SELECT kept.*, mean_score, std_score, CASE WHEN mean_score > 0 THEN score / mean_score ELSE 0 END AS multiple,
    CASE WHEN std_score > 0 THEN (score - mean_score) / std_score ELSE 0 END AS z_score,
    std_score > 0 AND score > mean_score + 2.0 * std_score AS outlier
    FROM kept JOIN stats USING (platform, handle))"""


def baselined(spark, sf_dir):
    return eng.with_baseline(eng.keep_since(posts(spark, sf_dir), SINCE))


@query("a_baseline", f"""{BASE_SQL} SELECT event_id, platform, handle, round(mean_score, 6) AS mean_score,
  round(std_score, 6) AS std_score, round(multiple, 6) AS multiple, outlier FROM based""")
def a_baseline(spark, sf_dir):
    return baselined(spark, sf_dir).select(
        "event_id", "platform", "handle", F.round("mean_score", 6).alias("mean_score"),
        F.round("std_score", 6).alias("std_score"), F.round("multiple", 6).alias("multiple"), "outlier")


@query("w_zscore", f"""{BASE_SQL} SELECT event_id, round(z_score, 6) AS z_score FROM based WHERE outlier""")
def w_zscore(spark, sf_dir):
    return baselined(spark, sf_dir).filter("outlier").select("event_id", F.round("z_score", 6).alias("z_score"))


@query("w_topn", f"""{SCORED_SQL} SELECT event_id, platform, handle, total, rn AS rank_in_account FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY platform, handle ORDER BY total DESC, event_id) AS INT) AS rn
  FROM scored) WHERE rn <= 3""")
def w_topn(spark, sf_dir):
    return eng.top_posts(posts(spark, sf_dir), 3).select("event_id", "platform", "handle", "total", "rank_in_account")


@query("x_perf", f"""{BASE_SQL}, b AS (SELECT event_id, floor(multiple * 4) / 4 AS baseline FROM based)
  SELECT event_id, CASE WHEN baseline > 0 THEN (CASE WHEN baseline >= 1 THEN '+' ELSE '' END)
    || CAST(round((baseline - 1) * 100) AS BIGINT) || '% vs baseline' END AS performance,
    baseline > 1 AS is_up FROM b""")
def x_perf(spark, sf_dir):
    quarter = F.floor(F.col("multiple") * 4) / 4
    return baselined(spark, sf_dir).select("event_id", eng.performance_text(quarter).alias("performance"),
                                           eng.performance_up(quarter).alias("is_up"))


@query("a_feedmeta", f"""{BASE_SQL}, accounts AS (SELECT DISTINCT platform, handle FROM scored)
  SELECT count(DISTINCT b.platform) AS platform_count, CAST(count(b.event_id) AS BIGINT) AS post_count,
    CAST(count_if(b.outlier) AS BIGINT) AS outlier_count,
    count(DISTINCT a.platform || '/' || a.handle) AS tracked_accounts
  FROM accounts a LEFT JOIN based b ON a.platform = b.platform AND a.handle = b.handle""")
def a_feedmeta(spark, sf_dir):
    accounts = POSTS.spark(spark, sf_dir).select("platform", "handle").distinct()
    kept = baselined(spark, sf_dir).select("platform", "handle", F.col("event_id").alias("post_key"), "outlier")
    return eng.feed_meta(accounts.join(kept, ["platform", "handle"], "left"))


PILLARS = "the thon, estion and than; ndly, ther!"
PILLAR_LIST_SQL = "['thon', 'estion', 'than', 'ndly', 'ther']"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
TOKENS_SQL = f"""list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\pL\\pM\\pN_\\s]', ' ', 'g'),
  '\\s+'), lambda w: length(w) > 1 AND NOT list_contains({STOP_SQL}, w)))"""


@query("x_tokens", f"""SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, list_min(t) AS first_token, list_max(t) AS last_token
  FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)""")
def x_tokens(spark, sf_dir):
    df = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return df.select("doc_id", F.size("t").alias("n_tokens"), F.array_min("t").alias("first_token"),
                     F.array_max("t").alias("last_token"))


@query("x_pillars", f"""SELECT doc_id, CAST(len(list_intersect(t, {PILLAR_LIST_SQL})) AS INT) AS n_shared
  FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)""")
def x_pillars(spark, sf_dir):
    pillars = text.literal_array(text.pillar_tokens(PILLARS))
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.size(F.array_intersect(text.tokens(F.col("text")), pillars)).alias("n_shared"))


RELEVANCE_SQL = f"""CASE WHEN shared = 0 THEN 0 ELSE least(1.0::DOUBLE, 0.65::DOUBLE * (shared / 5.0::DOUBLE)
  + 0.35::DOUBLE * (shared / least(n, 9)::DOUBLE)) END"""


@query("x_relevance", f"""SELECT doc_id, round({RELEVANCE_SQL}, 6) AS relevance FROM (
  SELECT doc_id, len(t) AS n, len(list_intersect(t, {PILLAR_LIST_SQL})) AS shared
  FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents))""")
def x_relevance(spark, sf_dir):
    raw = text.relevance_raw(F.col("text"), text.pillar_tokens(PILLARS))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.round(raw, 6).alias("relevance"))


# Posts of documents; the transcript of a post is the text of the document before it, known for the top posts of a source.
TRANSCRIPT_SQL = f"""WITH posts AS (SELECT doc_id, source, text, n_chars, 'https://v/' || doc_id AS url FROM documents),
  top AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5),
  spoken AS (SELECT 'https://v/' || (doc_id + 1) AS url, text AS transcript FROM documents WHERE doc_id % 2 = 0),
  heard AS (SELECT p.doc_id, p.text || CASE WHEN s.transcript IS NULL THEN ' ' ELSE ' ' || s.transcript END AS text FROM posts p
    LEFT JOIN top t ON p.doc_id = t.doc_id LEFT JOIN spoken s ON t.url = s.url)
  SELECT doc_id, round_even({RELEVANCE_SQL}, 2) AS relevance FROM (
  SELECT doc_id, len(t) AS n, len(list_intersect(t, {PILLAR_LIST_SQL})) AS shared FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM heard))"""


@query("j_transcript", TRANSCRIPT_SQL)
def j_transcript(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text", "n_chars")
    linked = docs.withColumn("url", F.expr("'https://v/' || doc_id"))
    spoken = docs.filter("doc_id % 2 = 0").selectExpr("'https://v/' || (doc_id + 1) AS url", "text AS transcript")
    heard = eng.attach_by_url(linked, spoken, 5, ["source"], "n_chars", "doc_id")
    return eng.rescored(heard, text.pillar_tokens(PILLARS)).select("doc_id", "relevance")


@query("u_intersect", f"""SELECT doc_id, len(list_intersect(t, {PILLAR_LIST_SQL})) > 0 AS overlaps
  FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)""")
def u_intersect(spark, sf_dir):
    pillars = text.literal_array(text.pillar_tokens(PILLARS))
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.arrays_overlap(text.tokens(F.col("text")), pillars).alias("overlaps"))


PAGE_URL: dict = {"spark": """CASE page_id % 6
  WHEN 0 THEN 'https://x.com/' || page_id || 'user/status/' || page_id
  WHEN 1 THEN 'https://www.instagram.com/reel/' || page_id
  WHEN 2 THEN 'https://www.tiktok.com/@clip' || page_id || '/video/1'
  WHEN 3 THEN 'https://www.youtube.com/@chan' || page_id || '/videos'
  WHEN 4 THEN 'https://www.instagram.com/pic' || page_id || '/p/AB/' ELSE url END"""}


@query("x_platform", f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'instagram' WHEN 2 THEN 'tiktok'
    WHEN 3 THEN 'youtube' WHEN 4 THEN 'instagram' END AS platform,
  CASE page_id % 6 WHEN 0 THEN page_id || 'user' WHEN 2 THEN 'clip' || page_id WHEN 3 THEN 'chan' || page_id
    WHEN 4 THEN 'pic' || page_id END AS handle FROM pages""")
def x_platform(spark, sf_dir):
    df = table(spark, sf_dir, "pages", "page_id", "url").selectExpr("page_id", f"{PAGE_URL['spark']} AS link")
    df = df.withColumn("platform", urls.platform_of(F.col("link")))
    return df.select("page_id", "platform", urls.handle_of(F.col("link"), F.col("platform")).alias("handle"))


@query("u_except", """SELECT page_id, 'Unsupported URL: ' || url AS error FROM pages WHERE page_id % 6 = 5""")
def u_except(spark, sf_dir):
    df = table(spark, sf_dir, "pages", "page_id", "url").selectExpr("page_id", f"{PAGE_URL['spark']} AS link")
    unknown = df.filter(urls.platform_of(F.col("link")).isNull())
    return unknown.select("page_id", F.concat(F.lit("Unsupported URL: "), F.col("link")).alias("error"))


@query("p_urlmode", f"""{SCORED_SQL} SELECT event_id, platform, round(score, 4) AS score,
  CAST(NULL AS DOUBLE) AS baseline, CAST(NULL AS BOOLEAN) AS outlier FROM scored""")
def p_urlmode(spark, sf_dir):
    df = posts(spark, sf_dir).drop("score").withColumn("text", F.lit(""))
    return eng.unaccounted(df, []).select("event_id", "platform", F.round("score", 4).alias("score"),
                                          "baseline", "outlier")


@query("x_clip", """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
  w AS (SELECT doc_id, t, t[1:281] AS win, regexp_extract(t[1:281], '(?s)^(.*[.!?]) ', 1) AS sent,
    regexp_extract(t[1:281], '(?s)^(.*) ', 1) AS word FROM f)
  SELECT doc_id, CASE WHEN length(t) <= 280 THEN t WHEN length(sent) - 1 >= 140 THEN sent
    WHEN length(word) > 0 THEN rtrim(word) || '…' ELSE t[1:280] || '…' END AS clipped FROM w""")
def x_clip(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", text.clip_text(F.col("text")).alias("clipped"))


ENRICH_SQL = f"""{SCORED_SQL}, linked AS (SELECT *, CASE WHEN k % 13 = 0 THEN '' ELSE 'https://p/' || event_id END AS url FROM scored),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY platform, handle ORDER BY total DESC, event_id) AS rn
    FROM linked WHERE url <> ''),
  comments AS (SELECT 'https://p/' || o_orderkey AS url, o_orderpriority AS comment FROM orders)
  SELECT l.event_id, c.comment FROM linked l LEFT JOIN ranked r ON l.event_id = r.event_id AND r.rn <= 3
    LEFT JOIN comments c ON r.url = c.url"""


@query("j_enrich", ENRICH_SQL)
def j_enrich(spark, sf_dir):
    linked = posts(spark, sf_dir).withColumn(
        "url", F.expr("CASE WHEN k % 13 = 0 THEN '' ELSE 'https://p/' || event_id END"))
    comments = table(spark, sf_dir, "orders").selectExpr("'https://p/' || o_orderkey AS url", "o_orderpriority AS comment")
    return eng.attach_by_url(linked, comments, 3).select("event_id", "comment")


@query("x_year", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'unknown'
    WHEN o_orderkey % 10 = 1 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE CAST(year(o_orderdate) AS VARCHAR) END AS y
  FROM orders""")
def x_year(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 10 > 1 THEN CAST(unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS STRING) "
        "ELSE '0' END AS internal_date",
        "CASE WHEN o_orderkey % 10 = 1 THEN date_format(o_orderdate, 'd MMM yyyy HH:mm:ss') ELSE 'soon' END AS header")
    return df.select("o_orderkey", dates.year_text(F.col("internal_date"), F.col("header")).alias("y"))
