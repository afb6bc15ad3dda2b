"""Registered queries: keyword alignment, creators, post ranking, capped selections, fuzzy rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmetric.functions import people, text
from quillmetric.operators import dictionary, joins, merge, ranking
from quillmetric.plans import fuzz_sql
from quillmetric.plans.registry import query
from quillmetric.tables import CONTACTS, NOW_MILLIS, TEXT_POSTS, View, table, with_sql

TARGETS = ranking.Targets(
    tier_a=("oure", "ndat", "org 75"), tier_b=("esat", "ndon", "of the"), tier_c=("ated", "ster", "thes"),
    platform_terms=("ndon",), company_slugs=("src5", "src3"), case_bound=frozenset({"ndat"}),
    aliases={"esat": "ndon", "thes": "ster"})

_A, _B, _C = "['oure', 'ndat', 'org 75']", "['esat', 'ndon', 'of the']", "['ated', 'ster', 'thes']"
_WORD = "regexp_matches(lower(text), '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')"
KEYED_SQL = f"""{with_sql(TEXT_POSTS, CONTACTS)}, h0 AS (SELECT *,
    list_filter({_A}, lambda t: CASE WHEN t = 'ndat' THEN regexp_matches(text, '(^|[^A-Za-z0-9])(Ndat|NDAT)([^A-Za-z0-9]|$)')
      ELSE {_WORD} END) AS ha,
    list_filter({_B}, lambda t: {_WORD}) AS hb, list_filter({_C}, lambda t: {_WORD}) AS hc FROM text_posts),
  h1 AS (SELECT *, list_concat(ha, hb, hc) AS hits, CASE WHEN len(ha) > 0 THEN 1.0 WHEN len(hb) > 0 THEN 0.7
    WHEN len(hc) > 0 THEN 0.3 ELSE 0 END::DOUBLE AS base FROM h0),
  h2 AS (SELECT *, CASE WHEN base = 0 THEN 0 ELSE least(1.0::DOUBLE, base + least(0.2::DOUBLE, 0.1::DOUBLE * (len(hits) - 1))) END AS align,
    list_min(list_transform(hits, lambda t, i: struct_pack(r := CASE WHEN t = 'ndon' THEN 0 WHEN list_contains({_A}, t) THEN 1
      WHEN list_contains({_B}, t) THEN 2 ELSE 3 END, i := i, t := t))).t AS primary_term FROM h1),
  keyed AS (SELECT *, CASE primary_term WHEN 'esat' THEN 'ndon' WHEN 'thes' THEN 'ster' ELSE coalesce(primary_term, '') END AS cluster FROM h2),
  creators AS (SELECT author_name, count(*) AS n_posts, CASE WHEN count(*) < 3 THEN 0
    ELSE least(1.0::DOUBLE, avg(CASE WHEN align >= 0.7 THEN 1.0::DOUBLE ELSE 0 END) / 0.5::DOUBLE) END AS creator_fit FROM keyed GROUP BY 1)"""


def keyed(spark, sf_dir):
    return ranking.with_keywords(TEXT_POSTS.spark(spark, sf_dir), TARGETS)


@query("j_keywords", f"{KEYED_SQL} SELECT doc_id, array_to_string(hits, '|') AS hits, round(align, 6) AS align FROM keyed WHERE len(hits) > 0")
def j_keywords(spark, sf_dir):
    return keyed(spark, sf_dir).filter(F.size("hits") > 0).select(
        "doc_id", F.array_join("hits", "|").alias("hits"), F.round("align", 6).alias("align"))


# a dictionary made of the benchmark's opening words: pairs, and single words of which every other one is bound to its case
TERMS = View("terms", "benchmark", {
    "term": "lower(split_part(text, ' ', 1)) || CASE WHEN item_id % 2 = 0 THEN ' ' || lower(split_part(text, ' ', 2)) ELSE '' END",
    "tier": "CAST(item_id % 3 AS INT)", "position": "CAST(item_id AS INT)", "case_bound": "item_id % 4 = 1"})
DICTIONARY_SQL = f"""{with_sql(TERMS)}, known AS (SELECT term, case_bound, min(struct_pack(tier := tier, position := position)) AS place FROM terms GROUP BY 1, 2),
  forms AS (SELECT *, unnest(CASE WHEN case_bound THEN list_distinct([upper(left(term, 1)) || substr(term, 2), upper(term)]) ELSE [term] END) AS form FROM known),
  met AS (SELECT DISTINCT doc_id, place, term FROM documents, forms WHERE contains(CASE WHEN case_bound THEN text ELSE lower(text) END, form)
    AND regexp_matches(CASE WHEN case_bound THEN text ELSE lower(text) END,
    '(^|[^' || CASE WHEN case_bound THEN 'A-Z' ELSE '' END || 'a-z0-9])' || regexp_escape(form) || '($|[^' || CASE WHEN case_bound THEN 'A-Z' ELSE '' END || 'a-z0-9])')),
  best AS (SELECT doc_id, term, min(place) AS place FROM met GROUP BY 1, 2)
  SELECT doc_id, string_agg(term, '|' ORDER BY place, term) AS hits FROM best GROUP BY doc_id"""


@query("j_keywords_table", DICTIONARY_SQL)
def j_keywords_table(spark, sf_dir):
    hits = dictionary.dictionary_hits(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", TERMS.spark(spark, sf_dir))
    return hits.select("doc_id", F.array_join("hits", "|").alias("hits"))


@query("t_cluster", f"{KEYED_SQL} SELECT doc_id, cluster FROM keyed")
def t_cluster(spark, sf_dir):
    return keyed(spark, sf_dir).select("doc_id", "cluster")


@query("a_creator", f"{KEYED_SQL} SELECT author_name, n_posts, round(creator_fit, 6) AS creator_fit FROM creators")
def a_creator(spark, sf_dir):
    return ranking.creator_fit(keyed(spark, sf_dir)).select("author_name", "n_posts", F.round("creator_fit", 6).alias("creator_fit"))


@query("a_rankcreators", f"""{KEYED_SQL} SELECT author_name, n_posts, round(creator_fit, 6) AS creator_fit FROM creators
  WHERE n_posts >= 3 ORDER BY creators.creator_fit DESC, n_posts DESC, author_name LIMIT 10""")
def a_rankcreators(spark, sf_dir):
    return ranking.rank_creators(keyed(spark, sf_dir)).select("author_name", "n_posts", F.round("creator_fit", 6).alias("creator_fit"))


AUTHOR_SQL = f"""{KEYED_SQL}, who AS (SELECT lower(author_alias) AS who, tier, company FROM contacts
    QUALIFY row_number() OVER (PARTITION BY lower(author_alias) ORDER BY contact_id DESC) = 1),
  linked AS (SELECT k.*, w.tier, lower(coalesce(w.company, '')) AS employer_key FROM keyed k
    LEFT JOIN who w ON lower(k.author_name) = w.who)"""


def linked(spark, sf_dir, posts=None):
    df = joins.attach_author(posts or keyed(spark, sf_dir), CONTACTS.spark(spark, sf_dir), "author_alias", "author_name",
                             "contact_id", ["tier", "company"])
    return df.withColumn("employer_key", people.clean_company(F.col("company")))


@query("j_author", f"{AUTHOR_SQL} SELECT doc_id, tier, employer_key FROM linked")
def j_author(spark, sf_dir):
    return linked(spark, sf_dir).select("doc_id", "tier", "employer_key")


@query("j_warmth", f"""{AUTHOR_SQL}, firsts AS (SELECT lower(author_alias) AS who, tier FROM contacts WHERE tier IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY lower(author_alias) ORDER BY contact_id) = 1)
  SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'WARM' END, f.tier) AS author_tier FROM text_posts p
    LEFT JOIN firsts f ON lower(p.author_name) = f.who""")
def j_warmth(spark, sf_dir):
    posts = TEXT_POSTS.spark(spark, sf_dir).select("doc_id", "author_name").withColumn(
        "author_tier", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'WARM' END"))
    return joins.fill_tier(posts, CONTACTS.spark(spark, sf_dir), "author_alias", "author_name", "contact_id").select(
        "doc_id", "author_tier")


QUEUED_SQL = "SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0"


def unqueued(spark, sf_dir, posts=None):
    queued = table(spark, sf_dir, "labels").filter("toxic = 1 OR quality = 0").select("doc_id")
    return joins.without_queued(linked(spark, sf_dir, posts), queued, "doc_id")


@query("j_queued", f"{AUTHOR_SQL} SELECT doc_id, cluster FROM linked WHERE doc_id NOT IN ({QUEUED_SQL})")
def j_queued(spark, sf_dir):
    return unqueued(spark, sf_dir).select("doc_id", "cluster")


SCORED_SQL = f"""{AUTHOR_SQL}, fits AS (SELECT l.*, c.creator_fit,
    CASE tier WHEN 'WARM' THEN 1.0 WHEN 'BRIDGE' THEN 0.7 WHEN 'COLD' THEN 0.3 ELSE 0 END::DOUBLE AS tier_fit,
    employer_key IN ('oure', 'ndat', 'org 75', 'src5', 'src3') OR lower(author_id) IN ('src5', 'src3') AS at_target,
    greatest(({NOW_MILLIS} - (CAST(post_id AS BIGINT) >> 22)) / 3600000.0::DOUBLE, 0) AS age_hours
    FROM linked l JOIN creators c USING (author_name) WHERE doc_id NOT IN ({QUEUED_SQL})),
  parts AS (SELECT *, CASE WHEN at_target THEN 1.0::DOUBLE ELSE greatest(tier_fit, creator_fit) END AS fit0,
    log10(comment_count + 1) AS x, (CASE WHEN length(text) < 80 THEN 0 WHEN length(text) < 200 THEN 0.6 ELSE 1 END)::DOUBLE AS comm FROM fits),
  scored AS (SELECT *, CASE WHEN align = 0 THEN 0 ELSE 35 * align
      + 25 * CASE WHEN author_type = 'company' THEN least(fit0, 0.6::DOUBLE) ELSE fit0 END
      + 20 * CASE WHEN age_hours <= 168 THEN pow(0.5::DOUBLE, age_hours / 48.0::DOUBLE) ELSE 0 END
      + 15 * exp(-pow(x - 1.7::DOUBLE, 2) / (2 * 0.6::DOUBLE * 0.6::DOUBLE)) + 5 * comm END AS score_raw FROM parts)"""


def scored(spark, sf_dir):
    posts = ranking.reduced(TEXT_POSTS.spark(spark, sf_dir), TARGETS)
    fits = ranking.creator_fit(posts).select("author_name", "creator_fit")
    return ranking.with_engagement_score(unqueued(spark, sf_dir, posts).join(fits, "author_name", "left"), NOW_MILLIS, TARGETS)


@query("t_engage", f"{SCORED_SQL} SELECT doc_id, round(score_raw, 6) AS score, round(age_hours, 6) AS age_hours FROM scored")
def t_engage(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", F.round("score_raw", 6).alias("score"), F.round("age_hours", 6).alias("age_hours"))


@query("f_rankgate", f"{SCORED_SQL} SELECT doc_id, cluster FROM scored WHERE score_raw > 0 AND round_even(score_raw, 2) >= 35 AND age_hours <= 168")
def f_rankgate(spark, sf_dir):
    return ranking.worth_answering(scored(spark, sf_dir), 35.0, 7).select("doc_id", "cluster")


GATED_SQL = f"""{SCORED_SQL}, near AS (SELECT *, round_even(score_raw, 2) AS s2, author_type = 'company' AS is_page, CASE WHEN trim(text) = '' THEN 'id:' || doc_id
      ELSE substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 120) END AS body
    FROM scored WHERE score_raw > 0 AND round_even(score_raw, 2) >= 35 AND age_hours <= 168),
  gated AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY author_name, body ORDER BY s2 DESC, doc_id) = 1),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s2 DESC, doc_id) AS pos FROM gated)"""


def gated(spark, sf_dir):
    kept = ranking.worth_answering(scored(spark, sf_dir), 35.0, 7)
    kept = merge.keep_best_of(kept, "near", "doc_id", "score")
    return kept.select("doc_id", "lang", "score", "author_name", "cluster", (F.col("author_type") == "company").alias("is_page"))


def _fold_sql(top, per_author, per_page, per_cluster):
    fits = (f"r.n < {top} AND len(list_filter(r.authors, lambda a: a = o.author_name)) < {per_author} "
            f"AND (NOT o.is_page OR r.pages < {per_page}) "
            f"AND len(list_filter(r.clusters, lambda c: c = o.cluster)) < {per_cluster}")
    return f"""WITH RECURSIVE {GATED_SQL[len('WITH '):]}, rec AS (
      SELECT lang, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS authors, CAST([] AS VARCHAR[]) AS clusters,
        0 AS pages, 0 AS n, CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS passed FROM (SELECT DISTINCT lang FROM ordered)
      UNION ALL
      SELECT r.lang, o.pos, CASE WHEN {fits} THEN list_append(r.authors, o.author_name) ELSE r.authors END,
        CASE WHEN {fits} THEN list_append(r.clusters, o.cluster) ELSE r.clusters END,
        CASE WHEN {fits} AND o.is_page THEN r.pages + 1 ELSE r.pages END,
        CASE WHEN {fits} THEN r.n + 1 ELSE r.n END,
        CASE WHEN {fits} THEN list_append(r.ids, o.doc_id) ELSE r.ids END,
        CASE WHEN {fits} THEN r.passed ELSE list_append(r.passed, o.doc_id) END
      FROM rec r JOIN ordered o ON o.lang = r.lang AND o.pos = r.pos + 1),
    done AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY lang ORDER BY pos DESC) = 1)"""


@query("t_diverse", f"""{_fold_sql(6, 2, 2, 2)} SELECT lang, CAST(generate_subscripts(ids, 1) AS INT) AS rank, unnest(ids) AS doc_id FROM done""")
def t_diverse(spark, sf_dir):
    return ranking.diverse_top(gated(spark, sf_dir), ["lang"], "score", "doc_id", "author_name", "cluster", "is_page",
                               top=6, per_author=2, per_page=2, per_cluster=2).select("lang", "rank", "doc_id")


@query("t_diverse_fill", f"""{_fold_sql(15, 2, 1, 2)}, f AS (SELECT lang, list_concat(ids, passed)[1:15] AS ids FROM done)
  SELECT lang, CAST(generate_subscripts(ids, 1) AS INT) AS rank, unnest(ids) AS doc_id FROM f""")
def t_diverse_fill(spark, sf_dir):
    return ranking.diverse_top(gated(spark, sf_dir), ["lang"], "score", "doc_id", "author_name", "cluster", "is_page",
                               top=15, per_author=2, per_page=1, per_cluster=2, fill_back=True).select("lang", "rank", "doc_id")


# ---- rankings with given similarity scores -------------------------------------

HEAD = "CASE contact_id % 4 WHEN 0 THEN 'Head of ' || focus WHEN 1 THEN 'Team lead, ex-Acme' WHEN 2 THEN 'Analyst' ELSE focus END"


@query("t_contacts", f"""{with_sql(CONTACTS)}, s AS (SELECT *, CAST(contact_id % 101 AS DOUBLE) AS role_score,
    CAST((contact_id * 7) % 101 AS DOUBLE) AS company_score, lower({HEAD}) AS low FROM contacts)
  SELECT contact_id, round(0.55::DOUBLE * role_score + 0.45::DOUBLE * company_score + CASE WHEN
    regexp_matches(low, 'head|vp|vice president|director|manager|lead|chief|founder|partner|principal|hiring') THEN 8 ELSE 0 END
    + CASE degree WHEN '1st' THEN 3 WHEN '2nd' THEN 1.5 ELSE 0 END + least(mutual_count * 0.2::DOUBLE, 2), 6) AS priority
  FROM s WHERE role_score >= 40 AND company_score >= 60""")
def t_contacts(spark, sf_dir):
    df = CONTACTS.spark(spark, sf_dir).selectExpr(
        "*", "CAST(contact_id % 101 AS DOUBLE) AS role_score", "CAST((contact_id * 7) % 101 AS DOUBLE) AS company_score",
        f"{HEAD} AS headline").filter("role_score >= 40 AND company_score >= 60")
    return df.select("contact_id", F.round(ranking.contact_priority(
        F.col("role_score"), F.col("company_score"), F.col("headline"), F.col("degree"), F.col("mutual_count"), True), 6).alias("priority"))


@query("t_jobs", """SELECT p_partkey, round((p_partkey % 101) * 0.6::DOUBLE + ((p_partkey * 7) % 101) * 0.4::DOUBLE, 6) AS priority
  FROM part WHERE p_partkey % 101 >= 40 AND (p_partkey * 7) % 101 >= 60""")
def t_jobs(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_partkey % 101 AS DOUBLE) AS role_score",
                                                 "CAST((p_partkey * 7) % 101 AS DOUBLE) AS company_score")
    df = df.filter("role_score >= 40 AND company_score >= 60")
    return df.select("p_partkey", F.round(ranking.composite(F.col("role_score"), F.col("company_score")), 6).alias("priority"))


@query("t_posts", f"""{AUTHOR_SQL} SELECT doc_id, round((doc_id % 101) * 0.6::DOUBLE + ((doc_id * 3) % 101) * 0.4::DOUBLE
  + CASE tier WHEN 'WARM' THEN 15 WHEN 'BRIDGE' THEN 8 WHEN 'COLD' THEN 2 ELSE 0 END
  + least((like_count + 3 * comment_count + 5 * repost_count) * 0.02::DOUBLE, 10), 6) AS priority
  FROM linked WHERE doc_id % 101 >= 40""")
def t_posts(spark, sf_dir):
    df = linked(spark, sf_dir).selectExpr("*", "CAST(doc_id % 101 AS DOUBLE) AS topic", "CAST((doc_id * 3) % 101 AS DOUBLE) AS who")
    return df.filter("topic >= 40").select("doc_id", F.round(ranking.topic_priority(
        F.col("topic"), F.col("who"), F.col("tier"), F.col("like_count"), F.col("comment_count"), F.col("repost_count")), 6).alias("priority"))


# ---- rankings with computed similarity -------------------------------------------

def _pairs(name, source, targets, candidates):
    """CTE of all (target, candidate) pairs of each row; the query's own parameters are the targets."""
    listed = ", ".join(f"'{t}'" for t in targets)
    return f"{name} AS (SELECT id, a, unnest({candidates}) AS b FROM (SELECT *, unnest([{listed}]) AS a FROM {source}))"


def _folded(parts, fold):
    return f"list_transform({parts}, lambda s: {fold('s')})"


ROLE_HEAD = "p_type || ' ' || p_name || ' at Sr Eng Org'"
EXPANDED_HEAD = "replace(head, 'Sr Eng', 'senior engineer')"
ROLES_SQL = f"""WITH heads AS (SELECT p_partkey AS id, {ROLE_HEAD} AS head FROM part),
  {_pairs('pairs', 'heads', ['red widget', 'senior engineer', 'sr eng', 'blue gear'],
          f"list_concat({_folded(fuzz_sql.segments('head'), fuzz_sql.plain)}, "
          f"{_folded(fuzz_sql.segments(EXPANDED_HEAD), fuzz_sql.plain)})")},
  {fuzz_sql.blended('found', 'pairs')} SELECT id AS p_partkey, score AS role_score FROM found"""


@query("j_roles", ROLES_SQL)
def j_roles(spark, sf_dir):
    df = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    head = F.concat_ws(" at ", F.concat_ws(" ", "p_type", "p_name"), F.lit("Sr Eng Org"))
    return ranking.with_role_score(df, ["red widget", "sr eng", "blue gear"], head).select("p_partkey", "role_score")


COMPANY_SQL = f"""WITH texts AS (SELECT p_partkey AS id, p_brand || ' at ' || p_name || ', Inc' AS t FROM part),
  {_pairs('pairs', 'texts', ['red widget'], _folded(fuzz_sql.segments('t'), fuzz_sql.company))},
  {fuzz_sql.blended('found', 'pairs', strict=True)} SELECT id AS p_partkey, score AS company_score FROM found"""


@query("j_company", COMPANY_SQL)
def j_company(spark, sf_dir):
    df = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    text_of = F.concat_ws(" at ", "p_brand", F.concat("p_name", F.lit(", Inc")))
    return ranking.with_company_score(df, "red widget", text_of).select("p_partkey", "company_score")


CONTACT_FUZZY_SQL = f"""{with_sql(CONTACTS)}, heads AS (SELECT contact_id AS id, *, focus || ' at ' || org AS head,
    replace(focus || ' at ' || org, 'VP', 'vice president') AS full_head FROM contacts),
  {_pairs('role_pairs', 'heads', ['vice president data', 'vp data', 'recruiter'],
          f"list_concat({_folded(fuzz_sql.segments('head'), fuzz_sql.plain)}, {_folded(fuzz_sql.segments('full_head'), fuzz_sql.plain)})")},
  {fuzz_sql.blended('roles', 'role_pairs')},
  {_pairs('own_pairs', 'heads', ['org 17'], _folded(fuzz_sql.segments('org'), fuzz_sql.company))}, {fuzz_sql.blended('own', 'own_pairs', strict=True)},
  {_pairs('head_pairs', 'heads', ['org 17'], _folded(fuzz_sql.segments('head'), fuzz_sql.company))}, {fuzz_sql.blended('top', 'head_pairs', strict=True)},
  found AS (SELECT h.*, r.score AS role_score, CASE WHEN o.score < 50 THEN greatest(o.score, t.score) ELSE o.score END AS company_score
    FROM heads h JOIN roles r USING (id) JOIN own o USING (id) JOIN top t USING (id))
  SELECT contact_id, role_score, company_score, round_even(0.55::DOUBLE * role_score + 0.45::DOUBLE * company_score
    + CASE WHEN regexp_matches(lower(head), 'head|vp|vice president|director|manager|lead|chief|founder|partner|principal|hiring') THEN 8 ELSE 0 END
    + CASE degree WHEN '1st' THEN 3 WHEN '2nd' THEN 1.5 ELSE 0 END + least(mutual_count * 0.2::DOUBLE, 2), 2) AS priority
  FROM found WHERE role_score >= 40 AND company_score >= 60"""


@query("t_contacts_fuzzy", CONTACT_FUZZY_SQL)
def t_contacts_fuzzy(spark, sf_dir):
    df = CONTACTS.spark(spark, sf_dir).selectExpr("contact_id", "focus || ' at ' || org AS headline", "org AS current_company",
                                                  "degree", "mutual_count")
    return ranking.rank_contacts(df, ["VP data", "recruiter"], "Org 17").select("contact_id", "role_score", "company_score", "priority")


JOBS_FUZZY_SQL = f"""WITH jobs AS (SELECT p_partkey AS id, * FROM part),
  {_pairs('role_pairs', 'jobs', ['red widget', 'old gear'], _folded(fuzz_sql.segments('p_name'), fuzz_sql.plain))}, {fuzz_sql.blended('roles', 'role_pairs')},
  {_pairs('firm_pairs', 'jobs', ['brand 17'], _folded(fuzz_sql.segments('p_brand'), fuzz_sql.company))}, {fuzz_sql.blended('firms', 'firm_pairs', strict=True)}
  SELECT id AS p_partkey, r.score AS role_score, f.score AS company_score, r.score * 0.6::DOUBLE + f.score * 0.4::DOUBLE AS priority
  FROM roles r JOIN firms f USING (id) WHERE r.score >= 40 AND f.score >= 60"""


@query("t_jobs_fuzzy", JOBS_FUZZY_SQL)
def t_jobs_fuzzy(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS title", "p_brand AS company")
    return ranking.rank_jobs(df, ["red widget", "old gear"], "Brand#17").select("p_partkey", "role_score", "company_score", "priority")


# Short posts, one per part, by the author of its brand.
NOTES = View("notes", "part", {
    "post_key": "p_partkey",
    "text": "p_type || ' ' || p_name || ': news of the ' || p_name || ' #' || replace(p_name, ' ', '')",
    "author_name": "'src' || (p_size % 20)",
    "like_count": "CAST(p_partkey % 211 AS BIGINT)",
    "comment_count": "CAST(p_size AS BIGINT)",
    "repost_count": "CAST(p_partkey % 13 AS BIGINT)",
})
POSTS_FUZZY_SQL = f"""{with_sql(NOTES, CONTACTS)}, posts AS (SELECT post_key AS id, *, text || ' ' || replace(regexp_extract(text, '#(.*)$', 1), ' ', '') AS combined FROM notes),
  {_pairs('topic_pairs', 'posts', ['red widget', 'old gear'], _folded(fuzz_sql.segments('combined'), fuzz_sql.plain))}, {fuzz_sql.blended('topics', 'topic_pairs')},
  {_pairs('name_pairs', 'posts', ['src1', 'src12'], '[author_name]')}, {fuzz_sql.blended('names', 'name_pairs').replace('max(coalesce(s.score, 0)), 2)', 'max(coalesce(s.score, 0)), 9)')},
  who AS (SELECT lower(author_alias) AS who, tier FROM contacts QUALIFY row_number() OVER (PARTITION BY lower(author_alias) ORDER BY contact_id DESC) = 1)
  SELECT post_key, t.score AS topic_score, round_even(t.score * 0.6::DOUBLE + n.score * 0.4::DOUBLE
    + CASE tier WHEN 'WARM' THEN 15 WHEN 'BRIDGE' THEN 8 WHEN 'COLD' THEN 2 ELSE 0 END
    + least((like_count + 3 * comment_count + 5 * repost_count) * 0.02::DOUBLE, 10), 2) AS priority
  FROM posts p JOIN topics t USING (id) JOIN names n USING (id) LEFT JOIN who w ON lower(p.author_name) = w.who WHERE t.score >= 40"""


@query("t_posts_fuzzy", POSTS_FUZZY_SQL)
def t_posts_fuzzy(spark, sf_dir):
    df = joins.attach_author(NOTES.spark(spark, sf_dir), CONTACTS.spark(spark, sf_dir), "author_alias", "author_name",
                             "contact_id", ["tier"])
    df = df.withColumn("hashtags", text.hashtags(F.col("text"), distinct=True))
    return ranking.rank_topic_posts(df, ["red widget", "old gear"], ["src1", "src12"]).select("post_key", "topic_score", "priority")
