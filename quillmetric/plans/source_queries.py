"""Registered queries: JSON, ledger, markdown, HTML and mail sources, and sinks read back.

Raw texts are built from table rows and parsed by the sources; the check SQL states the parsed values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmetric.functions.text import compute_once
from quillmetric.functions.urls import canonical_profile, host_of
from quillmetric.operators import engagement as eng
from quillmetric.operators import mail, quality
from quillmetric.plans.post_queries import TOTAL_SQL, posts
from quillmetric.plans.registry import query
from quillmetric.session import new_work_path, spread
from quillmetric.sources import html, json_posts, ledger, markdown, sinks
from quillmetric.tables import POSTS, table, with_sql

K_SPARK = "CAST(get_json_object(props, '$.k') AS BIGINT)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("*", f"{K_SPARK} AS k", "CAST(floor(value) AS BIGINT) AS likes")


EV = "(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS likes FROM events)"


@query("s_ledger", f"""SELECT event_id, event_type AS category, k AS step, 'run ' || user_id AS command FROM {EV} WHERE event_id % 10 > 1""")
def s_ledger(spark, sf_dir):
    lines = events(spark, sf_dir).selectExpr(
        "event_id", "CASE event_id % 10 WHEN 0 THEN '  ' WHEN 1 THEN '{\"category\": broken' ELSE ' ' || to_json(named_struct("
        "'category', event_type, 'stepIdx', k, 'command', 'run ' || user_id)) END AS value")
    return ledger.parse_entries(lines).select("event_id", "category", F.col("stepIdx").alias("step"), "command")


@query("s_ledger_files", f"""SELECT event_id AS timestamp, event_type AS category, k AS step, 'run ' || user_id AS command FROM {EV}
  WHERE event_id % 10 > 1""")
def s_ledger_files(spark, sf_dir):
    """Two ledgers that exist, with blank and broken lines, and one that does not."""
    work = new_work_path(spark, "ledgers")
    lines = events(spark, sf_dir).selectExpr(
        "event_id", "CASE event_id % 10 WHEN 0 THEN '  ' WHEN 1 THEN '{\"category\": broken' ELSE ' ' || to_json(named_struct("
        "'timestamp', event_id, 'category', event_type, 'stepIdx', k, 'command', 'run ' || user_id)) END AS value")
    for n in range(2):
        lines.filter(F.col("event_id") % 2 == n).select("value").write.text(f"{work}/ledger-{n}")
    found = ledger.read_ledgers(spark, [f"{work}/ledger-0", f"{work}/gone", f"{work}/ledger-1"])
    return found.select("timestamp", "category", F.col("stepIdx").alias("step"), "command")


X_ITEM = ("CASE WHEN event_id % 11 = 0 THEN '{\"noResults\": true}' WHEN event_id % 11 = 1 THEN '{\"error\": \"gone\"}' WHEN event_id % 11 = 2 "
          "THEN '[1]' ELSE to_json(named_struct('fullText', CASE WHEN k % 2 = 0 THEN '' ELSE 'full ' || k END, 'text', 'short ' || k, 'url', 'u' || event_id, "
          "'author', named_struct('userName', 'h' || user_id), 'createdAt', date_format(ts, 'E MMM dd') || ' 16:15:01 +0000 ' || date_format(ts, 'yyyy'), "
          "'likeCount', likes, 'retweetCount', 'junk', 'replyCount', CAST(k AS STRING), 'title', 'T' || k, 'viewCount', k * 10, 'commentsCount', k, "
          "'likes', likes, 'channelName', CASE WHEN k % 3 = 0 THEN '' ELSE 'chan' || k END, 'date', date_format(ts, 'yyyy-MM-dd') || 'T01:02:03Z', "
          "'content', 'C' || k, 'linkedinUrl', 'l' || event_id, 'postedAt', named_struct('date', date_format(ts, 'yyyy-MM-dd') || 'T01'), "
          "'engagement', named_struct('likes', likes, 'comments', k, 'shares', 2))) END AS item")
D = "strftime(ts, '%Y-%m-%d')"


def items(spark, sf_dir):
    raw = events(spark, sf_dir)
    made = compute_once(raw, item=F.expr(X_ITEM.rsplit(" AS ", 1)[0]))
    return json_posts.real_items(made.selectExpr("event_id", "'hand' || user_id AS handle", "item"))


@query("s_sentinel", "SELECT event_id FROM events WHERE event_id % 11 > 2")
def s_sentinel(spark, sf_dir):
    return items(spark, sf_dir).select("event_id")


@query("s_norm_x", f"""SELECT event_id, CASE WHEN k % 2 = 0 THEN 'short ' ELSE 'full ' END || k AS text, 'h' || user_id AS author, {D} AS post_date,
  likes, CAST(0 AS BIGINT) AS reposts, k AS replies FROM {EV} WHERE event_id % 11 > 2""")
def s_norm_x(spark, sf_dir):
    df = json_posts.x_posts(items(spark, sf_dir))
    return df.select("event_id", "text", "author", F.col("post_date").cast("string").alias("post_date"),
                     F.col("engagement.likes").alias("likes"), F.col("engagement.reposts").alias("reposts"),
                     F.col("engagement.replies").alias("replies"))


@query("s_norm_yt", f"""SELECT event_id, 'T' || k AS text, CASE WHEN k % 3 = 0 THEN 'hand' || user_id ELSE 'chan' || k END AS author, {D} AS post_date,
  k * 10 AS views, k AS comments, CASE WHEN k % 2 = 0 THEN 'short ' || k ELSE 'short ' || k END AS description FROM {EV} WHERE event_id % 11 > 2""")
def s_norm_yt(spark, sf_dir):
    df = json_posts.youtube_posts(items(spark, sf_dir))
    return df.select("event_id", "text", "author", F.col("post_date").cast("string").alias("post_date"),
                     F.col("engagement.views").alias("views"), F.col("engagement.comments").alias("comments"), "description")


@query("s_norm_li", f"""SELECT event_id, 'C' || k AS text, 'hand' || user_id AS author, {D} AS post_date, likes, CAST(2 AS BIGINT) AS shares
  FROM {EV} WHERE event_id % 11 > 2""")
def s_norm_li(spark, sf_dir):
    df = json_posts.linkedin_posts(items(spark, sf_dir))
    return df.select("event_id", "text", "author", F.col("post_date").cast("string").alias("post_date"),
                     F.col("engagement.likes").alias("likes"), F.col("engagement.shares").alias("shares"))


@query("s_nested", f"""SELECT event_id, 'x' AS platform, 'u' || user_id AS handle, CAST(p AS INT) AS position,
    CASE p WHEN 0 THEN 'a' || k ELSE 'b' || k END AS text, CAST(CASE p WHEN 0 THEN likes ELSE k END AS DOUBLE) AS likes FROM {EV}, range(2) t(p)
  UNION ALL SELECT event_id, 'youtube', 'empty', NULL, NULL, NULL FROM events""")
def s_nested(spark, sf_dir):
    docs = events(spark, sf_dir).selectExpr(
        "event_id", "'{\"results\":{\"x\":{\"u' || user_id || '\":[{\"text\":\"a' || k || '\",\"engagement\":{\"likes\":' || likes || '}},{\"text\":\"b' || k || "
        "'\",\"engagement\":{\"likes\":' || k || '}}]},\"youtube\":{\"empty\":[]}}}' AS value")
    df = json_posts.nested_posts(docs)
    return df.select("event_id", "platform", "handle", "position", F.col("post.text").alias("text"),
                     F.try_element_at("post.engagement", F.lit("likes")).alias("likes"))


WRAPPED = ("CASE event_id % 3 WHEN 0 THEN '[{\"score\":' || k || ',\"author\":\"a\",\"text\":\"t1\"},5,{\"rank\":9,\"post\":{\"author_name\":\"n' || k || "
           "'\",\"text\":\"inner\"},\"text\":\"outer\"}]' WHEN 1 THEN '{\"results\":[{\"score\":' || k || ',\"breakdown\":{\"hits\":[\"x\",\"y\"],\"age_hours\":36}}]}' "
           "ELSE '{\"posts\":\"no\",\"ranked\":[{\"post\":{\"author\":\"q\",\"like_count\":' || likes || '}}]}' END")


WRAPPED_SQL = f"""SELECT event_id, CAST(1 AS INT) AS rank, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN '?' ELSE 'q' END AS author,
    CAST(CASE WHEN event_id % 3 < 2 THEN k END AS DOUBLE) AS score, CASE event_id % 3 WHEN 0 THEN 't1' ELSE '' END AS text,
    CASE event_id % 3 WHEN 1 THEN 'x, y' ELSE '' END AS hits, CAST(CASE event_id % 3 WHEN 1 THEN 1.5 END AS DOUBLE) AS age_days,
    CASE event_id % 3 WHEN 2 THEN likes END AS likes FROM {EV}
  UNION ALL SELECT event_id, 9, 'n' || k, NULL, 'outer', '', NULL, NULL FROM {EV} WHERE event_id % 3 = 0"""


@query("s_wrapped", WRAPPED_SQL)
def s_wrapped(spark, sf_dir):
    docs = events(spark, sf_dir).selectExpr("event_id", f"{WRAPPED} AS value")
    return json_posts.ranked_posts(docs).select("event_id", "rank", "author", "score", "text", "hits", "age_days", "likes")


@query("w_position", f"SELECT event_id, rank FROM ({WRAPPED_SQL})")
def w_position(spark, sf_dir):
    docs = events(spark, sf_dir).selectExpr("event_id", f"{WRAPPED} AS value")
    return json_posts.ranked_posts(docs).select("event_id", "rank")


QUEUE = ("CASE o_orderkey % 3 WHEN 0 THEN to_json(named_struct('items', {0})) WHEN 1 THEN to_json(named_struct('actions', {0})) ELSE to_json({0}) END")
QUEUE_ITEMS = ("array(named_struct('target_type', 'dm', 'action_type', 'message', 'status', o_orderpriority, 'counterparty_name', 'C' || o_orderkey, "
               "'draft_content', 'hello'), named_struct('target_type', 'post', 'action_type', 'comment', 'status', o_orderstatus, "
               "'counterparty_name', 'P' || o_orderkey, 'draft_content', CAST(NULL AS STRING)))")


@query("s_queue", """SELECT 'dm' AS target_type, 'message' AS action_type, o_orderpriority AS status, 'C' || o_orderkey AS counterparty_name, 'hello' AS draft_content FROM orders
  UNION ALL SELECT 'post', 'comment', o_orderstatus, 'P' || o_orderkey, NULL FROM orders""")
def s_queue(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{QUEUE.format(QUEUE_ITEMS)} AS value")
    return json_posts.queue_items(docs).drop("position")


@query("s_logprefix", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN k ELSE likes END AS n FROM {EV}")
def s_logprefix(spark, sf_dir):
    docs = events(spark, sf_dir).selectExpr(
        "event_id", "'warming up...\\nloaded ' || user_id || ' rows\\n' || CASE WHEN event_id % 2 = 0 THEN '{\"n\":' || k || ',\"l\":[1]}' ELSE '[{\"n\":' || likes || '}]' END AS value")
    body = json_posts.after_noise(F.col("value"))
    return docs.select("event_id", F.coalesce(F.get_json_object(body, "$.n"), F.get_json_object(body, "$[0].n")).cast("bigint").alias("n"))


TABLE_DOC = ("'# Notes ' || o_orderkey || '\\n| A | B |\\n|---|---|\\n| no | table |\\n\\ntext | not a table\\n| Next step | **Company** | Role | Score | Status |\\n| :-- | --- | --- | --- | --- |\\n"
             "| call \\\\| mail | [Org ' || o_custkey || '](http://x) | `' || o_orderpriority || '` | 60 | Applied |\\n| short | Org B' || o_custkey || '\\n\\n## End'")


@query("s_mdtable", """SELECT o_orderkey, CAST(0 AS INT) AS position, 'Org ' || o_custkey AS company, o_orderpriority AS role, 'Applied' AS status, 'call | mail' AS next_action, '' AS follow_up FROM orders
  UNION ALL SELECT o_orderkey, 1, 'Org B' || o_custkey, '', '', 'short', '' FROM orders""")
def s_mdtable(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{TABLE_DOC} AS text")
    rows = markdown.first_table(docs, markdown.STAGE_HEADERS, ["company", "status"], key="o_orderkey")
    return rows.select("o_orderkey", "position", "company", "role", "status", "next_action", "follow_up")


SECTION_DOC = ("'intro\\n## Contact Records\\n\\n### Ann ' || o_custkey || '\\n- **Location:** Oslo\\n- **Company:** Org ' || o_custkey || '\\n\\n### Name — template\\n- **Location:** x\\n### Bo\\n"
               "https://www.linkedin.com/in/bo' || o_orderkey || ')\\n**Current role:** ' || o_orderpriority || '\\n## Other\\n### Cy\\n## contact records\\nlate'")


@query("s_mdsection", """SELECT o_orderkey, 'Ann ' || o_custkey AS title, 'Oslo' AS location, 'Org ' || o_custkey AS company, NULL AS url, NULL AS headline FROM orders
  UNION ALL SELECT o_orderkey, 'Bo', NULL, NULL, 'https://www.linkedin.com/in/bo' || o_orderkey, o_orderpriority FROM orders""")
def s_mdsection(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{SECTION_DOC} AS text")
    found = markdown.sections(docs, "o_orderkey").filter("heading = 'contact records'")
    return markdown.records(found, markdown.RECORD_FIELDS, "o_orderkey").select(
        "o_orderkey", "title", "location", "company", "url", "headline")


FRONT_DOC = ("CASE WHEN o_orderkey % 4 = 0 THEN 'plain ' || o_orderkey ELSE '---\\nname: \"n' || o_orderkey || '\"\\ndescription: first\\n  second ' || o_custkey || '\\n\\nname: last' || o_orderkey || "
             "'\\n---\\nbody --- ' || o_custkey END")


@query("s_frontmatter", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN 'last' || o_orderkey END AS name,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'first' || chr(10) || '  second ' || o_custkey END AS description,
    CASE WHEN o_orderkey % 4 = 0 THEN 'plain ' || o_orderkey ELSE 'body --- ' || o_custkey END AS body FROM orders""")
def s_frontmatter(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{FRONT_DOC} AS text")
    df = markdown.front_matter(docs, "o_orderkey")
    return df.select("o_orderkey", F.try_element_at("data", F.lit("name")).alias("name"),
                     F.try_element_at("data", F.lit("description")).alias("description"), "body")


FILES = "source || CASE WHEN doc_id % 3 = 0 THEN '/scripts/' WHEN doc_id % 1500 = 1 THEN '/assets/' ELSE '/' END || CASE WHEN doc_id % 40 = 7 THEN 'SKILL' ELSE '' || doc_id END || '.md'"


@query("s_files", f"""WITH f AS (SELECT source AS folder, {FILES} AS path, string_split_regex(regexp_replace(text, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|[\\n\\r]') AS ls FROM documents)
  SELECT folder, count(*) AS files, CAST(sum(len(ls)) AS BIGINT) AS lines, bool_or(path LIKE '%/SKILL.md') AS has_main,
    bool_or(path LIKE '%/scripts/%') AS has_scripts, bool_or(path LIKE '%/assets/%') AS has_assets FROM f GROUP BY 1""")
def s_files(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr(f"{FILES} AS path", "text")
    folder = F.substring_index("path", "/", 1)
    return markdown.inventory(files, folder, ("scripts", "assets")).select("folder", "files", "lines", "has_main", "has_scripts", "has_assets")


#: A written file holds at most so many texts, so that it fits a row when it is read back.
TEXTS_PER_FILE = 1000


@query("s_files_read", """SELECT lang, source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes,
    CAST(sum(len(text) - len(replace(text, chr(10), '')) + 1) AS BIGINT) AS line_ends FROM documents WHERE lang <> 'en' AND text IS NOT NULL GROUP BY ALL""")
def s_files_read(spark, sf_dir):
    work = new_work_path(spark, "files")
    texts = table(spark, sf_dir, "documents", "lang", "source", "text").filter("text IS NOT NULL")
    texts.write.partitionBy("lang", "source").option("maxRecordsPerFile", TEXTS_PER_FILE).text(f"{work}/tree")
    files = markdown.read_files(spark, f"{work}/tree", "*.txt", partitions=True).filter("lang <> 'en'")
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return files.groupBy("lang", "source").agg(F.sum("length").alias("bytes"), F.sum(ends).cast("bigint").alias("line_ends"))


@query("s_categorise", """WITH f AS (SELECT source AS folder, bool_or(contains(lower(text), 'worthless')) AS a1, bool_or(contains(lower(text), 'stupid ')) AS a2,
    bool_or(contains(lower(text), 'password')) AS s1 FROM documents GROUP BY 1)
  SELECT folder, CASE WHEN s1 THEN 'stays as is' WHEN a1 OR a2 THEN 'adaptable' ELSE 'safe to migrate' END AS category,
    array_to_string(list_filter([CASE WHEN a1 THEN 'worthless' END, CASE WHEN a2 THEN 'stupid ' END], lambda x: x IS NOT NULL), '|') AS words FROM f""")
def s_categorise(spark, sf_dir):
    df = markdown.folder_classes(table(spark, sf_dir, "documents").withColumnRenamed("source", "folder"), "folder", "text",
                                 ("worthless", "stupid "), ("password",))
    return df.select("folder", "category", F.array_join("agent_words", "|").alias("words"))


@query("s_pages", """WITH m AS (SELECT o_custkey AS id, o_orderkey AS page_no, 0 AS pos, 't' || o_orderkey AS thread_id FROM orders
    UNION ALL SELECT o_custkey + 1, o_orderkey, 1, 'v' || o_orderkey FROM orders)
  SELECT 'm' || id AS id, thread_id FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY page_no DESC, pos DESC) = 1""")
def s_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS page_no", "'{\"messages\":[{\"id\":\"m' || o_custkey || '\",\"threadId\":\"t' || o_orderkey || '\"},{\"id\":\"m' || (o_custkey + 1) || "
        "'\",\"threadId\":\"v' || o_orderkey || '\"}]}' AS value")
    return json_posts.message_pages(pages)


@query("s_ids", """SELECT DISTINCT o_orderkey % 4 AS kind, CASE o_orderkey % 4 WHEN 3 THEN 'line' ELSE 'id' END || x AS id
  FROM orders, (SELECT unnest([0, 1]) AS d) s, LATERAL (SELECT o_custkey + d AS x) y""")
def s_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey % 4 AS kind", "CASE o_orderkey % 4 WHEN 0 THEN '[\"id' || o_custkey || '\",{\"id\":\"id' || (o_custkey + 1) || '\"},\"\"]' WHEN 1 THEN '{\"ids\":[\"id' || o_custkey || '\",\"id' || (o_custkey + 1) || "
        "'\"]}' WHEN 2 THEN '{\"messages\":[{\"id\":\"id' || o_custkey || '\"},{\"id\":\"id' || (o_custkey + 1) || '\"},{}]}' ELSE '\\n line' || o_custkey || ' \\r\\n\\nline' || (o_custkey + 1) || '\\n' END AS value")
    return json_posts.id_list(docs, "value", F.col("kind") < 3)


@query("s_html", """SELECT page_id, replace(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')), '&amp;', '&') AS title,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, CAST(len(list_distinct(regexp_extract_all(html, '<a href="([^"]+)"', 1))) AS INT) AS links,
  CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS INT) AS headings FROM pages""")
def s_html(spark, sf_dir):
    df = html.extract_pages(table(spark, sf_dir, "pages"))
    return df.select("page_id", "title", "lang", F.size("links").alias("links"), F.size("headings").alias("headings"))


@query("s_html_hosts", """SELECT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, count(*) AS pages,
  CAST(sum(len(list_distinct(regexp_extract_all(html, '<a href="([^"]+)"', 1)))) AS BIGINT) AS links FROM pages GROUP BY 1""")
def s_html_hosts(spark, sf_dir):
    return html.host_summary(html.extract_pages(table(spark, sf_dir, "pages")), host_of(F.col("url"))).select("host", "pages", "links")


@query("s_defpairs", """SELECT page_id, 'host' AS label, url AS label_value FROM pages UNION ALL SELECT page_id, 'lang', 'dl' || page_id FROM pages
  UNION ALL SELECT page_id, 'size', 'n' || length(html) FROM pages""")
def s_defpairs(spark, sf_dir):
    df = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url", "html || '<dl><dt>Lang:</dt><dd>dl' || page_id || '</dd><dt>Host</dt><dd> ' || url || ' </dd><dt>lang</dt><dd>later</dd></dl><table><tr><th>LANG</th><td>td</td></tr>"
        "<tr><th>Size</th><td>n' || length(html) || '</td></tr></table>' AS html")
    return html.extract_pages(df).select("page_id", F.explode("pairs").alias("label", "label_value"))


PAYLOAD = ("'{\"data\":{\"elements\":[{\"title\":{\"text\":\"Cust ' || c_custkey || ' · badge\"},\"navigationUrl\":\"/in/C' || (c_custkey % 700) || '/\",\"primarySubtitle\":{\"text\":\"Lead at ' || c_mktsegment || "
           "'\"},\"badgeText\":{\"text\":\"• 2nd\"},\"secondarySubtitle\":\"N' || c_nationkey || '\"},{\"title\":\"Acme\",\"url\":\"https://www.linkedin.com/company/acme\"},{\"title\":\"\",\"publicIdentifier\":\"x\"}]},"
           "\"included\":[{\"title\":\"Inc ' || c_custkey || '\",\"publicIdentifier\":\"d' || c_custkey || '\",\"degree\":\"DISTANCE_3\",\"secondarySubtitle\":\"3 mutual connections\"}]}'")


@query("s_entity", """WITH f AS (SELECT c_custkey % 700 AS h, min(c_custkey) AS c FROM customer GROUP BY 1)
  SELECT 'https://www.linkedin.com/in/C' || h AS profile_url, 'Cust ' || c_custkey AS name, 'Lead at ' || c_mktsegment AS headline,
    'N' || c_nationkey AS location, '2nd' AS degree, c_mktsegment AS current_company FROM f JOIN customer ON f.c = c_custkey
  UNION ALL SELECT 'https://www.linkedin.com/in/d' || c_custkey, 'Inc ' || c_custkey, '', NULL, '3rd+', NULL FROM customer""")
def s_entity(spark, sf_dir):
    people = spread(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey"))
    payloads = people.selectExpr("c_custkey", f"{PAYLOAD} AS value")
    df = json_posts.entities(payloads, "c_custkey", "value", ("$.data.elements", "$.included"))
    return df.select("profile_url", "name", "headline", "location", "degree", "current_company")


# one entity per payload, one to eight levels deep, under a wrapper's name in every other payload
WALKED = ("repeat('{\"w\":[7,{\"k\":', c_custkey % 8) || CASE WHEN c_custkey % 2 = 0 THEN '{\"entityResult\":' ELSE '[' END || "
          "'{\"title\":\"Cust ' || c_custkey || '\",\"navigationUrl\":\"/in/W' || (c_custkey % 900) || '\",\"subtitle\":{\"text\":\"Lead at ' || "
          "c_mktsegment || '\"},\"badgeText\":\"• 3rd\"}' || CASE WHEN c_custkey % 2 = 0 THEN '}' ELSE ']' END || repeat('}]}', c_custkey % 8)")


@query("s_entity_walk", """SELECT 'https://www.linkedin.com/in/W' || (c_custkey % 900) AS profile_url, 'Cust ' || c_custkey AS name,
    'Lead at ' || c_mktsegment AS headline, '3rd+' AS degree, c_mktsegment AS current_company
  FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 900 ORDER BY c_custkey) = 1""")
def s_entity_walk(spark, sf_dir):
    payloads = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{WALKED} AS value")
    return json_posts.walked_entities(payloads, "c_custkey", "value").select("profile_url", "name", "headline", "degree", "current_company")


@query("f_person", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1")
def f_person(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 3 WHEN 0 THEN 'linkedin.com/in/c' || c_custkey WHEN 1 THEN 'https://www.linkedin.com/company/c' || c_custkey ELSE 'linkedin.com/c' || c_custkey END AS url")
    return json_posts.persons(df.withColumn("url", canonical_profile(F.col("url"))), "url").select("c_custkey")


@query("f_block", """SELECT CASE page_id % 5 WHEN 0 THEN 'path' WHEN 1 THEN 'title' ELSE 'ok' END AS block_kind, count(*) AS pages FROM pages GROUP BY 1""")
def f_block(spark, sf_dir):
    df = table(spark, sf_dir, "pages").selectExpr(
        "CASE page_id % 5 WHEN 0 THEN 'https://h.example.com/Checkpoint/' || page_id WHEN 2 THEN 'https://h.example.com/mynetwork/x' ELSE url END AS url",
        "CASE WHEN page_id % 5 IN (1, 2) THEN 'Please Sign In' ELSE 'Page' END AS title")
    return quality.blocked_pages(df, "url", "title")


# ---- mail ---------------------------------------------------------------------------

def messages(spark, sf_dir):
    """Orders as messages with headers, labels and sizes."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return o.selectExpr(
        "o_orderkey AS id", "o_custkey AS thread_id",
        "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN array('INBOX', 'STARRED') ELSE array('INBOX') END AS label_ids",
        "CAST(round(o_totalprice * 100) AS BIGINT) AS size_estimate",
        "CAST(unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS STRING) AS internal_date",
        "CASE WHEN o_orderkey % 25 = 0 THEN 'see Report.PDF' ELSE 'hello' END AS snippet",
        "array(named_struct('name', 'from', 'value', CASE WHEN o_orderkey % 30 = 0 THEN 'nobody' ELSE 'Shop <news@' || c_mktsegment || '.example.com>' END), "
        "named_struct('name', 'Subject', 'value', o_orderpriority)) AS headers",
        "CASE WHEN o_orderkey % 97 = 0 THEN 'timeout' END AS error")


POLICY = {"terms": ["5-LOW"], "domains": ["BUILDING.example.com", "xample.com"]}
MAIL_SQL = """WITH m AS (SELECT o_orderkey AS id, o_custkey AS thread_id, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes, CAST(year(o_orderdate) AS VARCHAR) AS year,
    CASE WHEN o_orderkey % 30 = 0 THEN '' ELSE lower(c_mktsegment) || '.example.com' END AS domain, o_orderpriority AS subject,
    CASE WHEN o_orderkey % 97 = 0 THEN 'timeout' END AS error, list_filter([
      CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'label:STARRED' END,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'term:5-LOW' END,
      CASE WHEN o_orderkey % 30 <> 0 AND c_mktsegment = 'BUILDING' THEN 'domain:BUILDING.example.com' END,
      CASE WHEN o_orderkey % 25 = 0 THEN 'extension:pdf' END], lambda x: x IS NOT NULL) AS reasons
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def classified(spark, sf_dir):
    raw = messages(spark, sf_dir)
    rows = mail.normalise(raw.filter("error IS NULL")).withColumn("error", F.lit(None).cast("string"))
    return mail.classify(rows, **POLICY)


def with_errors(spark, sf_dir):
    bad = messages(spark, sf_dir).filter("error IS NOT NULL").select("id", "error")
    return classified(spark, sf_dir).unionByName(bad, allowMissingColumns=True)


@query("f_hold", f"{MAIL_SQL} SELECT id, array_to_string(reasons, '|') AS reasons FROM m WHERE error IS NULL AND len(reasons) > 0")
def f_hold(spark, sf_dir):
    return classified(spark, sf_dir).filter("held").select("id", F.array_join("reasons", "|").alias("reasons"))


@query("a_bytes", f"""{MAIL_SQL}, g AS (SELECT 'domain' AS grouped_by, domain AS group_value, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes FROM m WHERE error IS NULL GROUP BY 2
    UNION ALL SELECT 'year', year, count(*), CAST(sum(bytes) AS BIGINT) FROM m WHERE error IS NULL GROUP BY 2)
  SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY grouped_by ORDER BY bytes DESC, messages DESC, group_value) <= 50""")
def a_bytes(spark, sf_dir):
    return mail.bytes_by_group(classified(spark, sf_dir)).select("grouped_by", "group_value", "messages", "bytes")


@query("a_auditsum", f"""{MAIL_SQL} SELECT CAST(count_if(error IS NULL AND len(reasons) = 0) AS BIGINT) AS candidates,
  CAST(coalesce(sum(CASE WHEN error IS NULL AND len(reasons) = 0 THEN bytes END), 0) AS BIGINT) AS candidate_bytes,
  CAST(count_if(error IS NULL AND len(reasons) > 0) AS BIGINT) AS held, CAST(coalesce(sum(CASE WHEN error IS NULL AND len(reasons) > 0 THEN bytes END), 0) AS BIGINT) AS held_bytes,
  CAST(count_if(error IS NOT NULL) AS BIGINT) AS errors FROM m""")
def a_auditsum(spark, sf_dir):
    return mail.audit_summary(with_errors(spark, sf_dir))


@query("t_largest", f"{MAIL_SQL} SELECT id, bytes FROM m WHERE error IS NULL AND len(reasons) = 0 ORDER BY bytes DESC, id LIMIT 50")
def t_largest(spark, sf_dir):
    return mail.largest(classified(spark, sf_dir).filter("NOT held")).select("id", "bytes")


@query("p_compact", f"{MAIL_SQL} SELECT id, thread_id, year, domain, subject FROM m WHERE error IS NULL")
def p_compact(spark, sf_dir):
    return mail.compact(classified(spark, sf_dir)).select("id", "thread_id", "year", "domain", "subject")


@query("f_query", """SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < DATE '2000-01-01' - 365
  AND o_orderdate > DATE '2000-01-01' - 1200 AND o_orderpriority = '2-HIGH' AND c_mktsegment = 'BUILDING' AND o_totalprice * 100 > 5000000 AND o_orderstatus <> 'F'""")
def f_query(spark, sf_dir):
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = df.selectExpr("o_orderkey AS id", "CAST(o_orderdate AS DATE) AS sent_on", "o_orderpriority AS category", "array('INBOX') AS label_ids",
                         "lower(c_mktsegment) AS domain", "o_totalprice * 100 AS bytes", "o_orderstatus = 'F' AS has_attachment")
    options = {"older_than_days": 365, "newer_than_days": 1200, "category": "2-HIGH", "label": "INBOX", "from_domain": "Building",
               "larger_than": 5000000, "has_attachment": False}
    return rows.filter(mail.filter_options(options, "2000-01-01")).select("id")


@query("k_audit", f"""{MAIL_SQL} SELECT 'candidates' AS part, count(*) AS n FROM m WHERE error IS NULL AND len(reasons) = 0
  UNION ALL SELECT 'held', count(*) FROM m WHERE error IS NULL AND len(reasons) > 0
  UNION ALL SELECT 'ids', count(*) FROM m WHERE error IS NULL AND len(reasons) = 0 UNION ALL SELECT 'errors', count(*) FROM m WHERE error IS NOT NULL""")
def k_audit(spark, sf_dir):
    rows = with_errors(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    paths = mail.write_audit(rows, new_work_path(spark, "audit"))
    count = F.count(F.lit(1)).alias("n")
    parts = [spark.read.parquet(paths["candidates"]).agg(count).withColumn("part", F.lit("candidates")),
             spark.read.parquet(paths["held"]).agg(count).withColumn("part", F.lit("held")),
             spark.read.text(paths["ids"]).agg(count).withColumn("part", F.lit("ids")),
             spark.read.schema("id string, error string").json(paths["errors"]).agg(count).withColumn("part", F.lit("errors"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("part", "n")


@query("k_feed", f"""{with_sql(POSTS)}, kept AS (SELECT count(DISTINCT platform) AS p, count(*) AS n, count(DISTINCT (platform, handle)) AS a FROM posts)
  SELECT platform, count(*) AS posts, CAST(sum({TOTAL_SQL}) AS BIGINT) AS sort_values, any_value(p) AS platform_count, any_value(n) AS post_count,
    any_value(a) AS tracked_accounts, 'kept' AS idea FROM posts, kept GROUP BY 1""")
def k_feed(spark, sf_dir):
    """Posts and meta of a feed are replaced, twice; an idea written in between is still there."""
    based = eng.with_baseline(posts(spark, sf_dir)).withColumns({
        "position": F.col("event_id"), "text": F.lit("post"), "url": F.lit(""), "author": F.lit(""), "relevance": F.lit(0.5)})
    meta = eng.feed_meta(based.withColumn("post_key", F.col("event_id")))
    out = new_work_path(spark, "feed")
    sinks.write_feed(eng.feed_posts(based).limit(0), meta, out)
    spark.range(1).selectExpr("'i1' AS id", "'kept' AS text").write.parquet(f"{out}/ideas")
    paths = sinks.write_feed(eng.feed_posts(based), meta, out)
    beside = spark.read.parquet(paths["meta"]).select("platform_count", "post_count", "tracked_accounts").join(
        sinks.read_ideas(spark, out).select(F.col("text").alias("idea")))  # one row each
    per = spark.read.parquet(paths["posts"]).groupBy("platform").agg(F.count(F.lit(1)).alias("posts"), F.sum("sort_value").alias("sort_values"))
    return per.join(beside)
