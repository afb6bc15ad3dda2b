"""Registered queries: keyed tables and incremental merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmetric.operators import merge
from quillmetric.plans.registry import query
from quillmetric.tables import CONTACTS, TEXT_POSTS, View, table, with_sql

STORED = View("stored", "customer", {
    "urn": "'c' || c_custkey", "name": "c_name", "headline": "c_mktsegment", "score": "c_acctbal",
    "location": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'N' || c_nationkey END",
    "source": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'base' END",
    "discovered": "'1990-01-01'", "seen": "'1990-01-01'",
    "url": "'https://www.linkedin.com/in/c' || c_custkey",
})
BATCH = View("batch", "orders", {
    "urn": "CASE WHEN o_orderstatus = 'P' THEN 'p' ELSE 'c' END || o_custkey",
    "seq": "o_orderkey", "name": "'Order ' || o_orderkey", "headline": "o_orderpriority", "score": "o_totalprice",
    "location": "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END",
    "source": "'batch'",
    "discovered": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "seen": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "url": "CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'https://www.linkedin.com/in/c' || o_custkey END",
})
STORE_SQL = f"""{with_sql(STORED, BATCH)}, last_rows AS (SELECT * FROM batch
  QUALIFY row_number() OVER (PARTITION BY urn ORDER BY seq DESC) = 1)"""


@query("j_upsert", f"""{STORE_SQL} SELECT coalesce(n.urn, o.urn) AS urn, coalesce(n.name, o.name) AS name,
  coalesce(n.headline, o.headline) AS headline, coalesce(n.score, o.score) AS score,
  coalesce(o.discovered, n.discovered) AS discovered FROM stored o FULL JOIN last_rows n ON o.urn = n.urn""")
def j_upsert(spark, sf_dir):
    return merge.upsert(STORED.spark(spark, sf_dir), BATCH.spark(spark, sf_dir), "urn",
                        {"name": "new", "headline": "new", "score": "new", "discovered": "old"}, "seq")


@query("j_coalesce", f"""{STORE_SQL} SELECT coalesce(n.urn, o.urn) AS urn,
  coalesce(n.location, o.location) AS location, coalesce(o.source, n.source) AS source,
  CASE WHEN o.urn IS NULL THEN n.discovered WHEN n.urn IS NULL THEN o.discovered ELSE least(o.discovered, n.discovered) END AS discovered,
  CASE WHEN o.urn IS NULL THEN n.seen WHEN n.urn IS NULL THEN o.seen ELSE greatest(o.seen, n.seen) END AS seen
  FROM stored o FULL JOIN last_rows n ON o.urn = n.urn""")
def j_coalesce(spark, sf_dir):
    return merge.upsert(STORED.spark(spark, sf_dir), BATCH.spark(spark, sf_dir), "urn", {
        "location": "new_else_old", "source": "old_else_new", "discovered": "min", "seen": "max"}, "seq")


@query("w_last", f"{STORE_SQL} SELECT urn, name, score FROM last_rows")
def w_last(spark, sf_dir):
    return merge.keep_last(BATCH.spark(spark, sf_dir), ["urn"], "seq").select("urn", "name", "score")


@query("w_first", f"""{with_sql(BATCH)} SELECT urn, name, score FROM batch
  QUALIFY row_number() OVER (PARTITION BY urn ORDER BY seq) = 1""")
def w_first(spark, sf_dir):
    return merge.keep_first(BATCH.spark(spark, sf_dir), ["urn"], [F.col("seq")]).select("urn", "name", "score")


@query("w_neardup", f"""{with_sql(TEXT_POSTS)}, k AS (SELECT doc_id, lang, like_count, post_id,
    CASE WHEN trim(text) = '' THEN 'id:' || doc_id ELSE substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 120) END AS body
    FROM text_posts)
  SELECT doc_id, lang, like_count FROM k
  QUALIFY row_number() OVER (PARTITION BY lang, body ORDER BY like_count DESC, doc_id) = 1""")
def w_neardup(spark, sf_dir):
    df = TEXT_POSTS.spark(spark, sf_dir)
    return merge.collapse_near_duplicates(df, "lang", "text", "doc_id", "like_count").select("doc_id", "lang", "like_count")


@query("j_remap", f"""{with_sql(STORED, BATCH)} SELECT b.seq, coalesce(s.urn, b.urn) AS urn, b.name
  FROM batch b LEFT JOIN stored s ON b.url <> '' AND b.url = s.url""")
def j_remap(spark, sf_dir):
    return merge.remap_keys(BATCH.spark(spark, sf_dir), STORED.spark(spark, sf_dir), "urn", "url").select("seq", "urn", "name")


@query("j_mirror", f"""{STORE_SQL} SELECT n.urn, n.name, coalesce(o.score, 0) AS kept_score,
  coalesce(n.location, o.location) AS location FROM last_rows n LEFT JOIN stored o ON n.urn = o.urn""")
def j_mirror(spark, sf_dir):
    latest = merge.keep_last(BATCH.spark(spark, sf_dir), ["urn"], "seq").drop("score")
    out = merge.mirror(latest, STORED.spark(spark, sf_dir), "urn", keep=["score"], fill=["location"])
    return out.select("urn", "name", F.coalesce("score", F.lit(0.0)).alias("kept_score"), "location")


HITS_SQL = """WITH base AS (SELECT 'c' || c_custkey AS urn, [c_mktsegment] AS segments FROM customer),
  hits AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'p' ELSE 'c' END || o_custkey AS urn, o_orderkey AS seq,
    CASE WHEN o_orderkey % 9 = 0 THEN 'BUILDING' ELSE o_orderpriority END AS segment FROM orders),
  firsts AS (SELECT urn, segment, min(seq) AS first_seq FROM hits GROUP BY ALL),
  fresh AS (SELECT urn, list(segment ORDER BY first_seq) AS fresh FROM firsts GROUP BY urn)"""


def _hits(spark, sf_dir):
    base = table(spark, sf_dir, "customer").selectExpr("'c' || c_custkey AS urn", "array(c_mktsegment) AS segments")
    hits = table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_orderstatus = 'P' THEN 'p' ELSE 'c' END || o_custkey AS urn", "o_orderkey AS seq",
        "CASE WHEN o_orderkey % 9 = 0 THEN 'BUILDING' ELSE o_orderpriority END AS segment")
    return merge.record_hits(base, hits, "urn", {"segment": "segments"}, "seq")


@query("j_provenance", f"""{HITS_SQL} SELECT coalesce(b.urn, f.urn) AS urn,
    array_to_string(list_concat(coalesce(segments, []), list_filter(coalesce(fresh, []),
      lambda s: NOT list_contains(coalesce(segments, []), s))), '|') AS segments, b.urn IS NULL AS is_new
  FROM base b FULL JOIN fresh f ON b.urn = f.urn""")
def j_provenance(spark, sf_dir):
    return _hits(spark, sf_dir).select("urn", F.array_join("segments", "|").alias("segments"), "is_new")


@query("u_ordered", f"""{HITS_SQL} SELECT CAST(count_if(b.urn IS NULL) AS BIGINT) AS new_rows, CAST(count_if(b.urn IS NOT NULL) AS BIGINT) AS known_rows
  FROM fresh f LEFT JOIN base b ON b.urn = f.urn""")
def u_ordered(spark, sf_dir):
    hit = F.col("was_hit")
    return _hits(spark, sf_dir).agg(F.count_if(hit & F.col("is_new")).alias("new_rows"),
                                    F.count_if(hit & ~F.col("is_new")).alias("known_rows"))


RECORDS = View("records", "customer", {
    "contact_urn": "CASE c_custkey % 4 WHEN 0 THEN 'urn:li:person:U' || c_custkey WHEN 1 THEN 'urn:li:member:u' || c_custkey "
                   "WHEN 2 THEN 'URN:LI:Member:U' || c_custkey ELSE 'other:u' || c_custkey END",
    "note": "c_name",
})


@query("j_rekey", f"""{with_sql(RECORDS)} SELECT CASE WHEN note IS NOT NULL AND contact_urn NOT LIKE 'other%'
  THEN 'urn:li:member:' || lower(split_part(contact_urn, ':', -1)) ELSE contact_urn END AS contact_urn, note FROM records""")
def j_rekey(spark, sf_dir):
    records = RECORDS.spark(spark, sf_dir)
    canonical = table(spark, sf_dir, "customer").selectExpr("'urn:li:member:u' || c_custkey AS contact_urn")
    return merge.rekey_orphans(records, canonical, "contact_urn")


@query("u_append", """WITH t AS (SELECT 'c' || c_custkey AS urn, c_name AS name FROM customer),
  d AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'P' THEN 'p' ELSE 'c' END || o_custkey AS urn, 'detail' AS name FROM orders)
  SELECT urn, name FROM t UNION ALL SELECT urn, name FROM d WHERE urn NOT IN (SELECT urn FROM t)""")
def u_append(spark, sf_dir):
    base = table(spark, sf_dir, "customer").selectExpr("'c' || c_custkey AS urn", "c_name AS name")
    extra = table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_orderstatus = 'P' THEN 'p' ELSE 'c' END || o_custkey AS urn", "'detail' AS name").distinct()
    return merge.append_missing(base, extra, "urn")


@query("u_union", """SELECT event_type AS category, value AS amount FROM events
  UNION ALL SELECT o_orderpriority, o_totalprice FROM orders""")
def u_union(spark, sf_dir):
    a = table(spark, sf_dir, "events").selectExpr("event_type AS category", "value AS amount")
    return a.unionByName(table(spark, sf_dir, "orders").selectExpr("o_totalprice AS amount", "o_orderpriority AS category"))


@query("k_stats", f"""{with_sql(CONTACTS)} SELECT count(*) AS rows, count(touch_date) AS with_touch_date,
  count(tier) AS with_tier, count(name) AS with_name FROM contacts""")
def k_stats(spark, sf_dir):
    return merge.coverage(CONTACTS.spark(spark, sf_dir), ["touch_date", "tier", "name"])


@query("s_table", f"""{with_sql(CONTACTS)} SELECT contact_id, name, company, degree, balance FROM contacts
  WHERE balance >= 1000 AND company ILIKE '%org 1%'""")
def s_table(spark, sf_dir):
    from quillmetric.operators.lookup import query_rows
    return query_rows(CONTACTS.spark(spark, sf_dir).select("contact_id", "name", "company", "degree", "balance"),
                      at_least={"balance": 1000.0}, like={"company": " org 1 ", "name": "  "}, equals={"degree": None})


ACTIONS = View("actions", "orders", {
    "action_id": "o_orderkey", "status": "'drafted'",
    "updated_at": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
})
CHANGES = View("changes", "lineitem", {
    "action_id": "l_orderkey + CASE WHEN l_returnflag = 'A' THEN 1000000000 ELSE 0 END",
    "seq": "l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey",
    "status": "CASE l_linestatus WHEN 'O' THEN 'approved' ELSE 'rejected' END",
    "changed_at": ("date_format(l_shipdate, 'yyyy-MM-dd')", "strftime(l_shipdate, '%Y-%m-%d')"),
})


@query("r_status", f"""{with_sql(ACTIONS, CHANGES)}, latest AS (SELECT * FROM changes
    QUALIFY row_number() OVER (PARTITION BY action_id ORDER BY seq DESC) = 1)
  SELECT a.action_id, coalesce(l.status, a.status) AS status, coalesce(l.changed_at, a.updated_at) AS updated_at
  FROM actions a LEFT JOIN latest l USING (action_id)""")
def r_status(spark, sf_dir):
    return merge.apply_status_changes(ACTIONS.spark(spark, sf_dir), CHANGES.spark(spark, sf_dir), "action_id", "seq")


@query("r_status_found", f"""{with_sql(ACTIONS, CHANGES)} SELECT a.action_id IS NOT NULL AS found, count(*) AS n
  FROM changes c LEFT JOIN actions a USING (action_id) GROUP BY 1""")
def r_status_found(spark, sf_dir):
    found = merge.change_results(ACTIONS.spark(spark, sf_dir), CHANGES.spark(spark, sf_dir), "action_id")
    return found.groupBy("found").agg(F.count(F.lit(1)).alias("n"))


@query("r_feedback", """SELECT user_id AS item_id, event_id AS last_review, event_type AS review FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def r_feedback(spark, sf_dir):
    reviews = table(spark, sf_dir, "events").selectExpr("user_id AS item_id", "event_id AS last_review", "event_type AS review")
    return merge.latest_by(reviews, "item_id", "last_review")


@query("r_stale", """SELECT o_orderkey, CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01'), 0) AS INT) AS age_days FROM orders""")
def r_stale(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", merge.staleness_days(F.to_date("o_orderdate"), F.lit("2000-01-01").cast("date")).alias("age_days"))


@query("r_cursor", """SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) >= greatest(DATE '2024-01-12', DATE '2024-01-31' - 20)""")
def r_cursor(spark, sf_dir):
    from quillmetric.functions import dates
    cutoff = dates.effective_since(F.lit("2024-01-12").cast("date"), "2024-01-31", dates.window_days(F.lit("20")))
    return table(spark, sf_dir, "events", "event_id", "user_id", "ts").filter(F.col("ts") >= cutoff.cast("timestamp_ntz")).select("event_id", "user_id")


@query("f_like", f"""{with_sql(CONTACTS)} SELECT contact_id, name, org, balance FROM contacts
  WHERE balance >= 0 AND org ILIKE '%circle 7%' AND degree = '2nd' ORDER BY balance DESC, name LIMIT 40""")
def f_like(spark, sf_dir):
    from quillmetric.operators.lookup import query_rows
    df = CONTACTS.spark(spark, sf_dir).select("contact_id", "name", "org", "balance", "degree")
    return query_rows(df, {"balance": 0.0}, {"org": "CIRCLE 7"}, {"degree": "2nd"},
                      [F.desc_nulls_last("balance"), F.asc("name")], 40).drop("degree")


@query("t_order", f"""{with_sql(CONTACTS)} SELECT contact_id, name, touch FROM (SELECT contact_id, name,
  strftime(touch_date, '%Y-%m-%d') AS touch FROM contacts) ORDER BY touch DESC NULLS LAST, name""")
def t_order(spark, sf_dir):
    df = CONTACTS.spark(spark, sf_dir).select("contact_id", "name", F.col("touch_date").cast("string").alias("touch"))
    return df.orderBy(F.desc_nulls_last("touch"), F.asc("name"))


@query("f_lookup", f"""{with_sql(TEXT_POSTS)}, req AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN post_id
    ELSE 'https://www.linkedin.com/feed/update/urn:li:activity:' || post_id || '/' END AS request, post_id FROM text_posts)
  SELECT r.request, p.doc_id FROM req r JOIN text_posts p USING (post_id)""")
def f_lookup(spark, sf_dir):
    from quillmetric.functions.urls import post_id
    from quillmetric.operators.lookup import lookup
    posts = TEXT_POSTS.spark(spark, sf_dir).select("doc_id", "post_id")
    requests = posts.selectExpr("CASE WHEN doc_id % 2 = 0 THEN post_id ELSE "
                                "'https://www.linkedin.com/feed/update/urn:li:activity:' || post_id || '/' END AS request").distinct()
    return lookup(requests, posts, "post_id", "request", post_id(F.col("request"))).select("request", "doc_id")


ENUM_SQL = f"""{with_sql(CONTACTS)}"""


@query("q_enum", f"""{ENUM_SQL} SELECT contact_id, CASE WHEN degree IN ('1st', '2nd', '3rd+', 'Unknown') THEN degree
  ELSE 'Unknown' END AS degree, NOT (degree IN ('1st', '2nd', '3rd+', 'Unknown')) AS replaced FROM contacts""")
def q_enum(spark, sf_dir):
    from quillmetric.functions.people import DEGREES, allowed_or
    df = CONTACTS.spark(spark, sf_dir)
    return df.select("contact_id", allowed_or(F.col("degree"), DEGREES, "Unknown").alias("degree"),
                     (~F.col("degree").isin(*DEGREES)).alias("replaced"))


@query("q_range", f"""{ENUM_SQL} SELECT count(*) AS rows, CAST(count_if(NOT balance BETWEEN 0 AND 9000) AS BIGINT) AS bad_balance,
  CAST(count_if(NOT mutual_count BETWEEN 0 AND 1) AS BIGINT) AS bad_mutual_count FROM contacts""")
def q_range(spark, sf_dir):
    from quillmetric.operators.quality import range_violations
    return range_violations(CONTACTS.spark(spark, sf_dir), {"balance": (0, 9000), "mutual_count": (0, 1)})


ROUTES = View("routes", "orders", {
    "route_id": "o_orderkey", "name": "'r' || o_custkey", "kind": "o_orderpriority", "grade": "o_orderstatus",
    "weight": "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END",
    "extra": "CASE WHEN o_orderkey % 70 = 0 THEN 'x' ELSE NULL END",
})


@query("q_schema", f"""{with_sql(ROUTES)} SELECT route_id, 'missing weight' AS problem FROM routes WHERE weight IS NULL
  UNION ALL SELECT route_id, 'unknown key extra' FROM routes WHERE extra IS NOT NULL
  UNION ALL SELECT route_id, 'bad grade ' || grade FROM routes WHERE grade NOT IN ('O', 'F')
  UNION ALL SELECT route_id, 'duplicate name' FROM routes WHERE name IN (SELECT name FROM routes GROUP BY 1 HAVING count(*) > 1)""")
def q_schema(spark, sf_dir):
    from quillmetric.operators.quality import config_violations
    df = ROUTES.spark(spark, sf_dir)
    entry = F.map_filter(F.create_map(
        F.lit("name"), F.col("name"), F.lit("kind"), F.col("kind"), F.lit("grade"), F.col("grade"),
        F.lit("weight"), F.col("weight").cast("string"), F.lit("extra"), F.col("extra")), lambda _k, v: v.isNotNull())
    return config_violations(df.select("route_id", entry.alias("entry")), "route_id", "entry",
                             required=["name", "kind", "weight"], optional=["grade"],
                             allowed={"grade": ["O", "F"]}, unique="name")
