"""Registered queries: outreach brief over contacts, pipeline rows and the message queue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillmetric.functions import numbers, people
from quillmetric.operators import joins, outreach
from quillmetric.plans.registry import query
from quillmetric.functions.text import compute_once
from quillmetric.tables import CONTACTS, RUN_DATE, STAGES, View, table, with_sql

TODAY = dt.date.fromisoformat(RUN_DATE)
T = f"DATE '{RUN_DATE}'"

LINK = "CASE state WHEN 'researching' THEN 12 WHEN 'networking' THEN 26 WHEN 'drafting' THEN 26 WHEN 'ready' THEN 22 WHEN 'applied' THEN 10 WHEN 'interviewing' THEN 30 ELSE 0 END"
FACTS_SQL = f"""{with_sql(CONTACTS, STAGES)},
  facts AS (SELECT company_base, max({LINK}) AS linkage,
      max(CASE WHEN {LINK} > 0 AND abs(date_diff('day', {T}, follow_up)) <= 3 THEN 10 ELSE 0 END) AS timing,
      arg_min(state, struct_pack(a := -{LINK}, b := row_id)) AS shown FROM stages GROUP BY 1),
  base AS (SELECT c.*, date_diff('day', touch_date, {T}) AS days_since,
      CASE contact_id % 9 WHEN 0 THEN 'none' WHEN 1 THEN 'sent' WHEN 2 THEN 'drafted' WHEN 3 THEN 'replied' WHEN 4 THEN 'closed'
        WHEN 8 THEN 'none' ELSE 'sent' END AS st,
      coalesce(touch_date, CASE WHEN contact_id % 9 = 6 THEN DATE '2024-05-13' END) AS ref,
      f.company_base IS NOT NULL AS has_rows, coalesce(f.linkage, 0) AS linkage, coalesce(f.timing, 0) AS timing, f.shown
    FROM contacts c LEFT JOIN facts f ON c.org_base = f.company_base),
  bus AS (SELECT *, CASE WHEN st = 'sent' AND ref IS NOT NULL THEN
      len(list_filter(range(ref + 1, {T}, INTERVAL 1 DAY), lambda d: isodow(d) < 6)) END AS bdays FROM base),
  kinds AS (SELECT *, CASE WHEN st = 'closed' OR coalesce(days_since < 2, false) THEN NULL
      WHEN st = 'none' THEN 'first_touch' WHEN st = 'drafted' THEN 'send_drafted'
      WHEN st = 'replied' THEN CASE WHEN contact_id % 2 = 0 OR coalesce(days_since >= 2, false) THEN 'warm_follow_up' END
      WHEN bdays < 5 THEN NULL WHEN contact_id % 9 = 7 THEN 'escalate' WHEN contact_id % 9 = 5 THEN 'nudge_2'
      ELSE 'nudge_1' END AS touch_type,
    linkage + timing + CASE degree WHEN '1st' THEN 25 WHEN '2nd' THEN 18 WHEN '3rd' THEN 6 ELSE 8 END
      + CASE WHEN contact_id % 5 = 0 OR contact_id % 4 = 0 THEN 10 WHEN contact_id % 5 IN (1, 3) THEN 6 ELSE 4 END AS fixed FROM bus),
  scored AS (SELECT *, least(100, fixed + CASE touch_type WHEN 'warm_follow_up' THEN 25 WHEN 'nudge_1' THEN 22 WHEN 'nudge_2' THEN 20
      WHEN 'send_drafted' THEN 18 WHEN 'first_touch' THEN 14 WHEN 'escalate' THEN 12 ELSE 0 END) AS score,
    least(100, fixed + 18) AS draft_score,
    touch_type IS NOT NULL AND NOT (has_rows AND linkage = 0 AND degree <> '1st') AS is_due FROM kinds)"""


def prepared(spark, sf_dir):
    contacts = CONTACTS.spark(spark, sf_dir).select("contact_id", "name", "org", "relationship", "focus", "status",
                                                    "next_action", "touch_date")
    return outreach.prepare(contacts, stages(spark, sf_dir), "contact_id", TODAY)


def stages(spark, sf_dir):
    return compute_once(STAGES.spark(spark, sf_dir).drop("state"), state=people.first_word_status(F.col("status")),
                        score_value=numbers.score_text(F.col("score")))


@query("j_org", f"{FACTS_SQL} SELECT contact_id, has_rows, CAST(linkage AS INT) AS linkage FROM base")
def j_org(spark, sf_dir):
    return prepared(spark, sf_dir).select("contact_id", "has_rows", "linkage")


@query("j_timing", f"{FACTS_SQL} SELECT contact_id, CAST(timing AS INT) AS timing FROM base WHERE timing > 0")
def j_timing(spark, sf_dir):
    return prepared(spark, sf_dir).filter("timing > 0").select("contact_id", "timing")


@query("j_lastref", f"{FACTS_SQL} SELECT contact_id, strftime(ref, '%Y-%m-%d') AS ref, CAST(bdays AS INT) AS business_days FROM bus WHERE st = 'sent'")
def j_lastref(spark, sf_dir):
    df = outreach.with_touch(CONTACTS.spark(spark, sf_dir), TODAY).filter("state = 'sent'")
    return df.select("contact_id", outreach.last_reference(F.col("touch_date"), F.col("status"), TODAY).cast("string").alias("ref"),
                     "business_days")


@query("f_due", f"{FACTS_SQL} SELECT contact_id, touch_type FROM scored WHERE is_due")
def f_due(spark, sf_dir):
    return outreach.due(prepared(spark, sf_dir)).select("contact_id", "touch_type")


WHY_SQL = """org || ' is ' || CASE WHEN has_rows THEN upper(shown[1]) || shown[2:] ELSE 'not in the pipeline' END || '; ' || degree || ' degree'
    || CASE WHEN degree = '2nd' THEN ' via Ann Lee' ELSE '' END || '; ' || CASE touch_type
      WHEN 'first_touch' THEN 'no prior touch, first touch due' WHEN 'send_drafted' THEN 'a draft is waiting to be sent'
      WHEN 'warm_follow_up' THEN 'they replied, follow up' ELSE
        coalesce(bdays || ' business days since last touch, ', 'last touch unknown, ') || CASE touch_type WHEN 'nudge_1' THEN 'nudge 1 due'
          WHEN 'nudge_2' THEN 'nudge 2 due' ELSE 'escalate to the department hiring manager or archive' END END"""


@query("t_dm", f"{FACTS_SQL} SELECT name, touch_type, CAST(score AS INT) AS score, {WHY_SQL} AS reason FROM scored WHERE is_due")
def t_dm(spark, sf_dir):
    df = outreach.due(prepared(spark, sf_dir))
    return df.select("name", "touch_type", "score", outreach.reason(F.col("org")).alias("reason")).orderBy(F.desc("score"), "name")


ITEMS = View("items", "orders", {
    "position": "o_orderkey",
    "target_type": "CASE WHEN o_orderstatus = 'F' THEN 'post' ELSE 'dm' END",
    "target_id": "o_custkey",
    "action_type": "CASE WHEN o_orderstatus = 'F' THEN 'comment' ELSE 'message' END",
    "status": "CASE o_orderpriority WHEN '1-URGENT' THEN 'approved' WHEN '2-HIGH' THEN 'drafted' ELSE 'rejected' END",
    "counterparty_name": "CASE WHEN o_orderkey % 7 = 0 THEN ' Stranger ' || (o_custkey % 50) "
                         "ELSE replace('Customer#' || (1000000000 + o_custkey), '#1', '#') END",
    "draft_content": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'draft ' || o_orderkey END",
})
# Some contacts share their name with the next one.
SHARED = ("CASE WHEN contact_id % 25 = 3 THEN 'Customer#' || lpad(CAST(contact_id + 1 AS STRING), 9, '0') ELSE name END",
          "CASE WHEN contact_id % 25 = 3 THEN 'Customer#' || lpad(CAST(contact_id + 1 AS VARCHAR), 9, '0') ELSE name END")
QUEUE_SQL = f"""{FACTS_SQL}, {ITEMS.sql}, wanted AS (SELECT lower(trim(counterparty_name)) AS who, *, trim(counterparty_name) AS shown_name FROM items
    WHERE target_type = 'dm' AND status IN ('approved', 'drafted')
    QUALIFY row_number() OVER (PARTITION BY lower(trim(counterparty_name)) ORDER BY CASE status WHEN 'approved' THEN 0 ELSE 1 END, position) = 1),
  people AS (SELECT *, {SHARED[1]} AS full_name, {WHY_SQL} AS why FROM scored),
  met AS (SELECT p.*, w.who, w.status AS item_status, w.draft_content, w.shown_name FROM people p FULL JOIN wanted w ON lower(p.full_name) = w.who
    WHERE w.who IS NOT NULL OR p.is_due),
  one AS (SELECT * FROM met WHERE who IS NULL UNION ALL (SELECT * FROM met WHERE who IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY who ORDER BY coalesce(is_due, false) DESC, CASE WHEN is_due THEN score END, contact_id DESC) = 1)),
  merged AS (SELECT coalesce(full_name, shown_name) AS name, coalesce(org, 'unknown') AS organization,
      CASE WHEN item_status = 'approved' THEN 'send_approved' WHEN who IS NOT NULL THEN 'review_queued' ELSE touch_type END AS touch_type,
      CAST(CASE WHEN item_status = 'approved' THEN 100 WHEN is_due THEN score ELSE coalesce(draft_score, 30) END AS INT) AS score,
      CASE WHEN who IS NOT NULL THEN coalesce(draft_content, '') END AS draft,
      CASE WHEN item_status = 'approved' THEN 'an approved draft waits to be sent' WHEN who IS NOT NULL THEN 'a draft waits for a decision' ELSE why END AS reason,
      CASE WHEN item_status = 'approved' THEN 'read it once more, then send it' WHEN who IS NOT NULL THEN 'approve it or reject it' END AS angle
    FROM one)"""


def queued(spark, sf_dir):
    people_rows = prepared(spark, sf_dir).withColumn("name", F.expr(SHARED[0]))
    return outreach.apply_queue(people_rows, ITEMS.spark(spark, sf_dir))


@query("j_queue", f"{QUEUE_SQL} SELECT * FROM merged")
def j_queue(spark, sf_dir):
    return queued(spark, sf_dir)


@query("t_orgcap", f"""{QUEUE_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS pos,
    CASE WHEN organization = 'unknown' THEN name ELSE split_part(regexp_replace(organization, ' Inc\\.| \\(labs\\)', ''), ' / ', 1) END AS grp FROM merged),
  r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos) AS in_grp FROM o)
  SELECT name, organization, score FROM r WHERE in_grp <= 2 OR organization = 'unknown' ORDER BY pos LIMIT 25""")
def t_orgcap(spark, sf_dir):
    return outreach.cap_per_org(queued(spark, sf_dir), 25, 2).select("name", "organization", "score")


@query("a_queued", f"""{with_sql(ITEMS)} SELECT CAST(count_if(target_type = 'post' AND status IN ('drafted', 'approved')) AS BIGINT) AS queued_comments FROM items""")
def a_queued(spark, sf_dir):
    return outreach.queued_comments(ITEMS.spark(spark, sf_dir))


@query("a_coverage", f"{with_sql(STAGES)} SELECT count(DISTINCT company_base) AS accounts FROM stages")
def a_coverage(spark, sf_dir):
    return outreach.coverage(STAGES.spark(spark, sf_dir))


COLD_SQL = f"""{FACTS_SQL}, cold AS (SELECT * FROM stages s WHERE state IN ('drafting', 'ready') AND NOT EXISTS (
    SELECT 1 FROM contacts c WHERE c.org_base = s.company_base AND date_diff('day', c.touch_date, {T}) BETWEEN 0 AND 14))"""


@query("j_recent", f"{COLD_SQL} SELECT row_id, company FROM cold")
def j_recent(spark, sf_dir):
    return outreach.cold_stages(stages(spark, sf_dir), CONTACTS.spark(spark, sf_dir), TODAY).select("row_id", "company")


@query("j_best", f"""{COLD_SQL}, best AS (SELECT org_base, name, touch_type FROM scored WHERE is_due
    QUALIFY row_number() OVER (PARTITION BY org_base ORDER BY score DESC, name) = 1)
  SELECT row_id, company, b.name AS best_name, b.touch_type AS best_touch FROM cold c LEFT JOIN best b ON c.company_base = b.org_base""")
def j_best(spark, sf_dir):
    ranked = outreach.due(prepared(spark, sf_dir)).select("name", "org", "touch_type", "score")
    cold = outreach.cold_stages(stages(spark, sf_dir), CONTACTS.spark(spark, sf_dir), TODAY).select("row_id", "company")
    return outreach.best_contact(cold, ranked)


@query("a_pipeorder", f"""{with_sql(STAGES)}, r AS (SELECT company_base AS company_key, row_id, CASE state WHEN 'interviewing' THEN 1 WHEN 'networking' THEN 2
    WHEN 'drafting' THEN 3 WHEN 'ready' THEN 4 WHEN 'applied' THEN 5 WHEN 'researching' THEN 6 END AS rk FROM stages)
  SELECT company_key, CAST(rk AS INT) AS stage_rank, row_id AS first_row FROM r WHERE rk IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY rk, row_id) = 1""")
def a_pipeorder(spark, sf_dir):
    return outreach.company_order(stages(spark, sf_dir))


@query("w_plan", """WITH q AS (SELECT 'S' || (p_size % 4 + 1) AS segment, p_size % 4 + 1 AS segment_rank, p_name AS query, p_partkey AS position FROM part),
  f AS (SELECT segment, segment_rank, query, min(position) AS position FROM q GROUP BY ALL)
  SELECT segment, query, CAST(page AS INT) AS page FROM f, range(1, 4) t(page) ORDER BY page, segment_rank, position LIMIT 60""")
def w_plan(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("'S' || (p_size % 4 + 1) AS segment", "p_size % 4 + 1 AS segment_rank",
                                                 "p_name AS query", "p_partkey AS position")
    return outreach.query_plan(df, 3, 60)


@query("a_actions", f"""{COLD_SQL}, {ITEMS.sql}, av AS (SELECT *, CASE WHEN score = '' THEN NULL ELSE
      (row_id % 40 + 20 + row_id % 40 + 41) / 2.0 END AS sv FROM stages),
  r AS (
   (SELECT 'A' AS rule, row_number() OVER (ORDER BY follow_up, row_id) AS pos, 'Overdue follow-up: ' || company || ' (' || role || ')' AS title, 10 AS est_minutes
      FROM stages WHERE follow_up <= {T} AND state <> 'rejected' QUALIFY pos <= 2)
   UNION ALL (SELECT 'B', row_number() OVER (ORDER BY row_id) AS pos, 'Warm up ' || company || ' before applying', 15 FROM cold QUALIFY pos <= 2)
   UNION ALL (SELECT 'C', 1, 'Review and approve your ' || n || ' queued comment drafts', 10 FROM (SELECT count(*) AS n FROM items
      WHERE target_type = 'post' AND status IN ('drafted', 'approved')) WHERE n >= 3)
   UNION ALL (SELECT 'D', 1, 'Proactive audit: ' || company, 30 FROM av WHERE state IN ('interviewing', 'networking') AND sv IS NOT NULL
      ORDER BY sv DESC, company, row_id LIMIT 1)
   UNION ALL SELECT 'E', 1, 'Fresh-requisition sweep (past 4 hours)', 15),
  p AS (SELECT *, CAST(row_number() OVER (ORDER BY rule, pos) AS INT) AS place FROM r)
  SELECT place, rule, title, CAST(est_minutes AS INT) AS est_minutes FROM p WHERE place <= 5""")
def a_actions(spark, sf_dir):
    ranked = outreach.due(prepared(spark, sf_dir)).select("name", "org", "touch_type", "score")
    return outreach.actions(stages(spark, sf_dir), CONTACTS.spark(spark, sf_dir), ranked, ITEMS.spark(spark, sf_dir), TODAY, True)


@query("j_counter", """WITH a AS (SELECT o_orderkey AS action_id, CASE WHEN o_orderstatus = 'F' THEN 'post' WHEN o_orderstatus = 'O' THEN 'dm' ELSE 'page' END AS target_type,
    o_custkey AS target_id FROM orders)
  SELECT action_id, target_type, CASE target_type WHEN 'dm' THEN c_name WHEN 'post' THEN s_name END AS counterparty_name
  FROM a LEFT JOIN customer ON target_id = c_custkey LEFT JOIN supplier ON target_id = s_suppkey""")
def j_counter(spark, sf_dir):
    acts = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS action_id", "CASE WHEN o_orderstatus = 'F' THEN 'post' WHEN o_orderstatus = 'O' THEN 'dm' ELSE 'page' END AS target_type",
        "o_custkey AS target_id")
    threads = table(spark, sf_dir, "customer").selectExpr("c_custkey AS thread_id", "c_name AS participant_name")
    posts = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS post_id", "s_name AS author_name")
    return joins.with_counterparty(acts, threads, posts).select("action_id", "target_type", "counterparty_name")


SOCIAL = View("social", "documents", {
    "author_type": "CASE WHEN doc_id % 4 = 0 THEN 'company' ELSE 'person' END",
    "author_id": "CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 9 = 1 THEN NULL ELSE 'urn:li:member:' || upper(source) END",
    "like_count": "CAST(CASE WHEN doc_id % 8 = 0 THEN NULL ELSE n_chars % 50 END AS BIGINT)",
    "comment_count": "CAST(n_chars % 7 AS BIGINT)", "repost_count": "CAST(n_chars % 3 AS BIGINT)",
})
LINKS = View("links", "customer", {
    "contact_id": "c_custkey", "profile_url": "'https://www.linkedin.com/in/Src' || (c_custkey % 30) || '/'",
    "current_company": "CASE c_custkey % 3 WHEN 0 THEN 'src' || (c_custkey % 25) WHEN 1 THEN 'Src ' || (c_custkey % 25) || ', Inc.' ELSE NULL END",
})


@query("j_posts", f"""{with_sql(SOCIAL, LINKS)}, p AS (SELECT author_type = 'company' AS page, lower(replace(author_id, 'urn:li:member:', '')) AS k,
    coalesce(like_count, 0) + comment_count + repost_count AS eng FROM social WHERE author_id IS NOT NULL),
  s AS (SELECT page, k, count(*) AS n, sum(eng) AS eng FROM p GROUP BY ALL),
  l AS (SELECT *, 'src' || (contact_id % 30) AS h, CASE WHEN current_company IS NOT NULL THEN 'src' || (contact_id % 25) END AS co FROM links),
  j AS (SELECT l.contact_id, coalesce(o.n, 0) AS own_n, coalesce(o.eng, 0) AS own_e, coalesce(c.n, 0) AS co_n, coalesce(c.eng, 0) AS co_e
    FROM l LEFT JOIN s o ON NOT o.page AND o.k = l.h LEFT JOIN s c ON c.page AND c.k = l.co)
  SELECT contact_id, CAST(own_n + co_n AS BIGINT) AS posts, CAST(own_n AS BIGINT) AS own_posts, CAST(co_n AS BIGINT) AS company_posts,
    CAST(own_e + co_e AS BIGINT) AS total_engagement FROM j""")
def j_posts(spark, sf_dir):
    df = joins.connections_with_posts(LINKS.spark(spark, sf_dir), SOCIAL.spark(spark, sf_dir))
    return df.select("contact_id", "posts", "own_posts", "company_posts", "total_engagement")


@query("j_detail", """WITH c AS (SELECT p_partkey AS contact_id, p_name || ' ' || p_partkey AS name FROM part),
  d AS (SELECT s_suppkey AS detail_id, CASE s_suppkey % 4 WHEN 0 THEN 'Ring ' || s_suppkey WHEN 1 THEN 'the small bolt ' || s_suppkey || ' desk'
    WHEN 2 THEN 'gear & Ring ' || s_suppkey ELSE cast(s_suppkey as varchar) END AS title FROM supplier)
  SELECT contact_id, min(detail_id) AS detail_id FROM c, d WHERE NOT regexp_matches(lower(title), ' & | and ')
    AND (contains(lower(name), lower(title)) OR contains(lower(title), lower(name))) GROUP BY 1""")
def j_detail(spark, sf_dir):
    contacts = table(spark, sf_dir, "part").selectExpr("p_partkey AS contact_id", "p_name || ' ' || p_partkey AS name")
    details = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS detail_id", "CASE s_suppkey % 4 WHEN 0 THEN 'Ring ' || s_suppkey WHEN 1 THEN 'the small bolt ' || s_suppkey || ' desk' "
        "WHEN 2 THEN 'gear & Ring ' || s_suppkey ELSE CAST(s_suppkey AS STRING) END AS title")
    return joins.first_detail(contacts, details, "contact_id", "name", "detail_id", "title")


@query("j_history", """WITH h AS (SELECT DISTINCT 'Emp' || (c_custkey % 300) AS employer, c_mktsegment AS title, 'N' || (c_nationkey % 3) AS dates FROM customer),
  c AS (SELECT o_orderkey, 'EMP' || (o_custkey % 350) AS employer, CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS title,
    'N' || (o_orderkey % 3) AS dates FROM orders),
  e AS (SELECT lower(employer) AS k, list(DISTINCT title || ' | ' || dates) AS v FROM h GROUP BY 1)
  SELECT o_orderkey, CASE WHEN v IS NULL THEN 'missing' WHEN list_contains(v, title || ' | ' || dates) THEN 'match' ELSE 'conflict' END AS verdict,
    CASE WHEN v IS NOT NULL AND NOT list_contains(v, title || ' | ' || dates) THEN array_to_string(list_sort(v), '; ') END AS expected
  FROM c LEFT JOIN e ON lower(c.employer) = e.k""")
def j_history(spark, sf_dir):
    history = table(spark, sf_dir, "customer").selectExpr("'Emp' || (c_custkey % 300) AS employer", "c_mktsegment AS title",
                                                          "'N' || (c_nationkey % 3) AS dates")
    claims = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'EMP' || (o_custkey % 350) AS employer",
                                                       "CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS title",
                                                       "'N' || (o_orderkey % 3) AS dates")
    return joins.check_history(claims, history, "employer", ["title", "dates"]).select("o_orderkey", "verdict", "expected")




@query("j_urn1", """SELECT 'u' || o_custkey AS public_id, 'Cust ' || o_custkey AS name, min(o_orderkey) AS payload_id FROM orders
  WHERE o_orderkey % 3 <> 0 GROUP BY ALL""")
def j_urn1(spark, sf_dir):
    payloads = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS payload_id",
        "array(named_struct('type', 'connection', 'urn', 'c', 'ref', 'p' || o_custkey, 'first_name', CAST(NULL AS STRING), 'last_name', "
        "CAST(NULL AS STRING), 'public_id', CAST(NULL AS STRING), 'headline', '', 'created_at', unix_millis(CAST(o_orderdate AS TIMESTAMP))), "
        "named_struct('type', 'connection', 'urn', 'd', 'ref', 'missing', 'first_name', '', 'last_name', '', 'public_id', '', 'headline', '', "
        "'created_at', CAST(0 AS BIGINT)), named_struct('type', CASE WHEN o_orderkey % 3 = 0 THEN 'school' ELSE 'profile' END, 'urn', 'p' || o_custkey, "
        "'ref', CAST(NULL AS STRING), 'first_name', 'Cust', 'last_name', CAST(o_custkey AS STRING), 'public_id', 'u' || o_custkey, "
        "'headline', o_orderpriority, 'created_at', CAST(NULL AS BIGINT))) AS entities")
    return joins.connections_from_entities(payloads, "payload_id", "entities").select("public_id", "name", "payload_id")


@query("j_urn2", """SELECT o_orderkey AS post_id, CASE WHEN o_orderkey % 5 <> 0 AND o_custkey % 3 <> 0 THEN c_nationkey::BIGINT END AS like_count,
    CASE WHEN o_orderkey % 5 <> 0 AND o_custkey % 3 <> 0 THEN (c_custkey % 7)::BIGINT END AS comment_count
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def j_urn2(spark, sf_dir):
    blank = "CAST(NULL AS BIGINT)"
    orders = table(spark, sf_dir, "orders")
    posts = orders.selectExpr("'post' AS type", "'post' || o_orderkey AS urn", "CASE WHEN o_orderkey % 5 = 0 THEN 'gone' ELSE 'detail' || o_custkey END AS ref",
                              "o_orderkey AS post_id", f"{blank} AS likes", f"{blank} AS comments", f"{blank} AS shares")
    customer = table(spark, sf_dir, "customer")
    detail = customer.selectExpr("'detail' AS type", "'detail' || c_custkey AS urn",
                                 "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'counts' || c_custkey END AS ref", f"{blank} AS post_id",
                                 f"{blank} AS likes", f"{blank} AS comments", f"{blank} AS shares")
    counts = customer.selectExpr("'counts' AS type", "'counts' || c_custkey AS urn", "CAST(NULL AS STRING) AS ref", f"{blank} AS post_id",
                                 "CAST(c_nationkey AS BIGINT) AS likes", "c_custkey % 7 AS comments", "c_custkey % 5 AS shares")
    return joins.posts_with_counts(posts.unionByName(detail).unionByName(counts)).select("post_id", "like_count", "comment_count")


@query("j_span", """SELECT o_orderkey, 'user' || o_orderkey AS handle, 'ACoAA' || o_custkey AS member FROM orders
  UNION ALL SELECT o_orderkey, 'late' || o_orderkey, 'ACoAAx' || o_custkey FROM orders WHERE o_orderkey % 2 = 0""")
def j_span(spark, sf_dir):
    texts = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "'x ConnectionCard_1-User' || o_orderkey || ' a ConnectionCard_1-User' || o_orderkey || ' fsd_profile:ACoAA' || o_custkey "
        "|| ' fsd_profile:ACoAAother ConnectionCard_2-none y ConnectionCard_3-Late' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN "
        "' fsd_profile%3AACoAAx' || o_custkey ELSE '' END AS body")
    return joins.ids_in_spans(texts, "o_orderkey", "body", r"ConnectionCard_\d+-([^\"\\\s]+)", r"fsd_profile(?:%3A|:)(ACoAA[\w-]+)")
