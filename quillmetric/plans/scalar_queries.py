"""Registered queries: column functions over names, URLs, numbers and dates.

Inputs are texts that Spark builds from each row of a table; the check SQL states the value each
text must give, or computes it with its own pattern.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmetric.functions import dates, fuzz, numbers, people, text, urls
from quillmetric.operators.mail import header, sender_domain
from quillmetric.plans import fuzz_sql
from quillmetric.plans.registry import query
from quillmetric.session import spread
from quillmetric.tables import NOW_MILLIS, TEXT_POSTS, table, with_sql


def case(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


def by_row(name, source, key, inputs, outputs, build):
    """Register a query: ``inputs[i]`` is the text of rows with key % n = i, ``outputs`` its expected columns."""
    expected = ", ".join(f"{case(key, values)} AS {column}" for column, values in outputs.items())

    @query(name, f"SELECT {key}, {expected} FROM {source}")
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source).selectExpr(key, f"{case(key, inputs)} AS t")
        return df.select(key, *[c.alias(n) for n, c in build(F.col("t")).items()])
    return run


def q(*values):
    return ["NULL" if v is None else (str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'") for v in values]


by_row("x_canonurl", "orders", "o_orderkey", [
    "'http://linkedin.com//in//User-' || o_orderkey || '/?x=1'",
    "'www.linkedin.com/jobs/view/web-lead-' || o_orderkey || '?ref=1'",
    "'https://www.linkedin.com/jobs/search/?currentJobId=' || o_orderkey",
    "'https://linkedin.com.example.org/in/u' || o_orderkey",
    "'https://de.linkedin.com/company/Acme-' || o_orderkey || '/about/'",
    "'linkedin.com/user_' || o_orderkey",
    "'https://www.linkedin.com/feed/update/urn:li:activity:' || o_orderkey || '/?y'",
    "''"],
    {"profile": ["'https://www.linkedin.com/in/User-' || o_orderkey",
                 "'https://www.linkedin.com/jobs/view/web-lead-' || o_orderkey",
                 "'https://www.linkedin.com/jobs/search'", "NULL",
                 "'https://www.linkedin.com/company/Acme-' || o_orderkey || '/about'",
                 "'https://www.linkedin.com/in/user_' || o_orderkey",
                 "'https://www.linkedin.com/feed/update/urn:li:activity:' || o_orderkey", "''"],
     "handle": ["'user-' || o_orderkey", "NULL", "NULL", "NULL", "NULL", "'user_' || o_orderkey", "NULL", "NULL"],
     "job": ["NULL", "CAST(o_orderkey AS VARCHAR)", "CAST(o_orderkey AS VARCHAR)", "NULL", "NULL", "NULL", "NULL", "NULL"],
     "company": ["NULL", "NULL", "NULL", "NULL", "'acme-' || o_orderkey", "'user_' || o_orderkey", "NULL", "NULL"],
     "post": ["NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "CAST(o_orderkey AS VARCHAR)", "NULL"],
     "rejected": ["false", "false", "false", "true", "false", "false", "false", "false"]},
    lambda t: {"profile": urls.canonical_profile(t), "handle": urls.profile_handle(t), "job": urls.job_id(t),
               "company": urls.company_slug(t), "post": urls.post_id(t),
               "rejected": urls.foreign_host(t) & (t != "")})


by_row("x_slug", "part", "p_partkey", [
    "p_name || ' %26 ' || p_brand", "'  ' || p_type || '--' || p_name || '! '"],
    {"dashed": ["regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g')",
                "regexp_replace(lower(p_type || '--' || p_name), '[^a-z0-9]+', '-', 'g')"],
     "joined": ["regexp_replace(lower(p_name || '26' || p_brand), '[^a-z0-9]+', '', 'g')",
                "regexp_replace(lower(p_type || p_name), '[^a-z0-9]+', '', 'g')"]},
    lambda t: {"dashed": text.slug_dash(t), "joined": text.slug_join(t)})

TAIL_SQL = "|".join(people.COMPANY_TAIL_WORDS)
COMPANY_TEXT = [
    "p_name || ' Technologies, Inc.'", "'The ' || p_name || '.io'", "p_name || ' Labs AI'", "'inc'",
    "p_brand || ' GmbH / ' || p_name || ' via ' || p_type", "p_name || ' (formerly ' || p_brand || '), LLC Ltd. Co'"]


@query("x_company", f"""WITH s AS (SELECT p_partkey, {case('p_partkey', COMPANY_TEXT)} AS t FROM part),
  w AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace(t, '(?i)\\.(com|ai|io|net|org|co)\\b', '', 'g')),
    '[^\\pL\\pM\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS c FROM s)
  SELECT p_partkey, regexp_replace(c, '(\\S)(?: (?:{TAIL_SQL}))+$', '\\1') AS company_key FROM w""")
def x_company(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{case('p_partkey', COMPANY_TEXT)} AS t")
    return df.select("p_partkey", people.clean_company(F.col("t")).alias("company_key"))


by_row("x_company2", "part", "p_partkey", COMPANY_TEXT,
       {"shown": ["p_name || ' Technologies'", "p_name", "p_name || ' Labs AI'", "'inc'",
                  "p_brand || ' GmbH / ' || p_name || ' via ' || p_type", "p_name || ' (formerly ' || p_brand || ')'"]},
       lambda t: {"shown": people.display_company(t)})

by_row("x_orgkey", "part", "p_partkey", COMPANY_TEXT,
       {"aliases": ["lower(p_name) || ' technologies'", "'the ' || lower(p_name) || ' io'",
                    "lower(p_name) || ' labs'", "''",
                    "replace(lower(p_brand), '#', ' ') || ' gmbh|' || lower(p_name) || '|' || lower(p_type) || '|' || "
                    "replace(lower(p_brand), '#', ' ') || ' gmbh ' || lower(p_name) || ' via ' || lower(p_type)",
                    "lower(p_name) || ' ltd co'"]},
       lambda t: {"aliases": F.array_join(people.org_aliases(t), "|")})

by_row("x_expand", "customer", "c_custkey", [
    "'Sr. SWE, ' || c_name", "'VP of Eng & TPM at ' || c_mktsegment", "'Semi-pro pm_lead ' || c_name", "''"],
    {"expanded": ["'senior. software engineer, ' || c_name",
                  "'vice president of engineer & technical program manager at ' || c_mktsegment",
                  "'Semi-pro pm_lead ' || c_name", "''"]},
    lambda t: {"expanded": people.expand_roles(t)})

HEADLINES = ["'Head of Data at ' || c_name || ' | ex-Acme'", "'Former lead @ ' || c_name || ', now idle'",
             "'Data Lead | ' || c_name", "c_name || ' · Growth at scale'", "'Attache'"]
by_row("x_segment", "customer", "c_custkey", HEADLINES, {
    "parts": ["'Head of Data;' || c_name || ';ex;Acme;Head of Data at ' || c_name || ' | ex-Acme'",
              "'Former lead;' || c_name || ';now idle;Former lead @ ' || c_name || ', now idle'",
              "'Data Lead;' || c_name || ';Data Lead | ' || c_name",
              "c_name || ';Growth;scale;' || c_name || ' · Growth at scale'", "'Attache'"]},
    lambda t: {"parts": F.array_join(people.segments(t), ";")})
by_row("x_employer", "customer", "c_custkey", HEADLINES, {
    "strict": ["c_name", "NULL", "NULL", "'scale'", "NULL"],
    "loose": ["c_name", "c_name", "c_name", "'scale'", "NULL"]},
    lambda t: {"strict": people.employer(t), "loose": people.employer_loose(t)})

by_row("x_degree", "customer", "c_custkey",
       q("2nd", "DISTANCE_1", "third degree", " · 3rd+ ", "FIRST friend", "OUT_OF_NETWORK", "x21st", ""), {
           "badge": q("2nd", "Unknown", "Unknown", "3rd+", "Unknown", "Unknown", "Unknown", "Unknown"),
           "code": q("2nd", "1st", "Unknown", "3rd+", "Unknown", "3rd+", "Unknown", "Unknown"),
           "mention": q("2nd", "Unknown", "3rd+", "3rd+", "1st", "Unknown", "1st", "Unknown"),
           "word": q("2nd", "unknown", "3rd", "3rd", "1st", "unknown", "unknown", "unknown")},
       lambda t: {"badge": people.degree_badge(t), "code": people.degree_code(t),
                  "mention": people.degree_mention(t), "word": people.degree_word(t)})

MUTUALS = ["'Ann Lee and 3 other mutual connections'", "'12 mutual connections: Bo Chu, Cy Day and 2 others'",
           "c_name || ' is a mutual connection'", "'4 mutuals (Ed Fox, Gia Hu, etc.); mutuals: Io Jay, +5 more'",
           "'none'"]
by_row("x_mutuals", "customer", "c_custkey", MUTUALS, {
    "proof": ["'4:Ann Lee'", "'12:'", "'1:'", "'4:'", "'0:'"],
    "insight": ["'1:'", "'12:Bo Chu;Cy Day'", "'1:'", "'0:Io Jay;+5 more'", "'0:'"],
    "note": ["'0:'", "'12:'", "'0:'", "'4:Ed Fox;Gia Hu'", "'0:'"],
    "names": ["''", "''", "''", "'Io Jay;Ed Fox;Gia Hu'", "''"]},
    lambda t: {"proof": joined(people.mutuals_proof(t)), "insight": joined(people.mutuals_insight(t)),
               "note": joined(people.mutuals_note(t)), "names": F.array_join(people.mutual_names(t), ";")})


def joined(pair):
    return F.concat(pair["count"].cast("string"), F.lit(":"), F.array_join(pair["sample"], ";"))


by_row("x_status", "customer", "c_custkey",
       q("Re-pitching later", "Touch 2 booked", "Connection request sent", "connected!", "Deferred", "not sent",
         "do not contact (2024)", "Applied - 3"), {
           "outreach": q("archived", "replied", "messaged", "connected", "drafted", "messaged", "discovered", "messaged"),
           "stage": q("re", "touch", "connection", "connected", "deferred", "not", "do", "applied"),
           "touch": q("none", "replied", "sent", "none", "none", "none", "closed", "sent")},
       lambda t: {"outreach": people.outreach_status(t), "stage": people.first_word_status(t),
                  "touch": people.touch_state(t)})

by_row("x_enummap", "customer", "c_custkey",
       q("Remote  (EU)", "On site, Full-time", "Part  time contract", "Mid-Senior level", "11-50 employees",
         "10,001+ employees", "about 30 people", ""), {
           "workplace": q("remote", "onSite", None, None, None, None, None, None),
           "employment": q(None, "fullTime", "partTime", None, None, None, None, None),
           "experience": q(None, None, None, "midSeniorLevel", None, None, None, None),
           "company_size": q("Unknown", "Unknown", "Unknown", "Unknown", "11-50", "10001+", "Unknown", None)},
       lambda t: {"workplace": numbers.first_label(t, numbers.WORKPLACES),
                  "employment": numbers.first_label(t, numbers.EMPLOYMENTS),
                  "experience": numbers.first_label(t, numbers.EXPERIENCES),
                  "company_size": numbers.company_size(t)})

by_row("x_compactnum", "orders", "o_orderkey", [
    "CAST(o_orderkey % 1000 + 1 AS STRING) || ',000 followers'", "'about ' || (o_orderkey % 90 + 10) || '.5K+'",
    "(o_orderkey % 9 + 1) || '.25M'", "'none'", "CAST(o_orderkey AS STRING)"], {
        "n": ["CAST((o_orderkey % 1000 + 1) * 1000 AS BIGINT)", "CAST((o_orderkey % 90 + 10) * 1000 + 500 AS BIGINT)",
              "CAST((o_orderkey % 9 + 1) * 1000000 + 250000 AS BIGINT)", "NULL", "CAST(o_orderkey AS BIGINT)"]},
    lambda t: {"n": numbers.compact_number(t)})


@query("x_salary", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 100 + 50) * 1000.0::DOUBLE
      WHEN 1 THEN 40000.0::DOUBLE WHEN 2 THEN 25.5::DOUBLE WHEN 4 THEN 3000.0::DOUBLE END AS salary_min,
    CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 100 + 80) * 1000.0::DOUBLE WHEN 1 THEN 55000.0::DOUBLE
      WHEN 2 THEN 40.0::DOUBLE WHEN 4 THEN 4000.0::DOUBLE END AS salary_max,
    CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS currency,
    CASE o_orderkey % 5 WHEN 0 THEN 'yearly' WHEN 2 THEN 'hourly' WHEN 4 THEN 'monthly' END AS pay_interval FROM orders""")
def x_salary(spark, sf_dir):
    inputs = ["'$' || (o_orderkey % 100 + 50) || 'K/yr - $' || (o_orderkey % 100 + 80) || 'K/yr'",
              "'€40,000 to €55,000'", "'£25.5/hr – £40/hr'", "'competitive'", "'3000 - 4000 per month'"]
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{case('o_orderkey', inputs)} AS t")
    pay = numbers.salary_range(F.col("t"))
    return df.select("o_orderkey", pay["salary_min"].alias("salary_min"), pay["salary_max"].alias("salary_max"),
                     pay["currency"].alias("currency"), pay["interval"].alias("pay_interval"))


by_row("x_scoretext", "orders", "o_orderkey", [
    "(o_orderkey % 50) || '–' || (o_orderkey % 50 + 9) || ' provisional; midpoint ' || (o_orderkey % 50 + 4)",
    "'from ' || (o_orderkey % 50) || ' to ' || (o_orderkey % 50 + 9) || ' of 100'", "'about ' || (o_orderkey % 50) || '.5'",
    "'n/a'"], {
        "score": ["CAST(o_orderkey % 50 + 4 AS DOUBLE)", "CAST(o_orderkey % 50 + 4.5 AS DOUBLE)",
                  "CAST(o_orderkey % 50 + 0.5 AS DOUBLE)", "NULL"]},
    lambda t: {"score": numbers.score_text(t)})

D = "CAST(o_orderdate AS DATE)"
DATE_TEXT = [f"date_format(o_orderdate, 'MMMM d, yyyy') || ' (call)'", f"'**' || date_format(o_orderdate, 'yyyy-MM-dd') || '** sent'",
             "'TBD'", "'some day soon'", f"'on ' || date_format(o_orderdate, 'MMM d yyyy')", "'2024-02-31'"]
ISO = f"strftime({D}, '%Y-%m-%d')"
by_row("x_dates", "orders", "o_orderkey", DATE_TEXT, {"free": [ISO, ISO, "NULL", "NULL", ISO, "NULL"]},
       lambda t: {"free": dates.free_date(t).cast("string")})


@query("x_dates_fixed", f"""SELECT o_orderkey, {ISO} AS social, {ISO} AS iso, {ISO} AS connected, {ISO} AS epoch_s, {ISO} AS epoch_ms,
  strftime({D} - 30, '%Y-%m-%d') AS month_ago FROM orders""")
def x_dates_fixed(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").selectExpr(
        "o_orderkey", "CAST(o_orderdate AS DATE) AS d",
        "date_format(o_orderdate, 'E MMM d') || ' 16:15:01 +0000 ' || date_format(o_orderdate, 'yyyy') AS social",
        "date_format(o_orderdate, 'yyyy-MM-dd') || 'T10:00:00Z' AS iso",
        "'Connected on ' || date_format(o_orderdate, 'MMMM d, yyyy') AS connected",
        "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) + 3600 AS s")
    as_text = lambda c: c.cast("string")
    return df.select(
        "o_orderkey", as_text(dates.social_date(F.col("social"))).alias("social"),
        as_text(dates.iso_prefix(F.col("iso"))).alias("iso"),
        as_text(dates.connected_on(F.col("connected"))).alias("connected"),
        as_text(F.to_date(dates.epoch_to_timestamp(F.col("s")))).alias("epoch_s"),
        as_text(F.to_date(dates.epoch_to_timestamp(F.col("s") * 1000))).alias("epoch_ms"),
        as_text(dates.days_before(F.col("d"), 30)).alias("month_ago"))


@query("x_baddate", f"""SELECT o_orderpriority, CAST(count_if(o_orderkey % 6 IN (3, 5)) AS BIGINT) AS unreadable,
  count(*) AS total FROM orders GROUP BY 1""")
def x_baddate(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_orderpriority", f"{case('o_orderkey', DATE_TEXT)} AS t")
    return df.groupBy("o_orderpriority").agg(F.count_if(dates.unreadable_date(F.col("t"))).alias("unreadable"),
                                             F.count(F.lit(1)).alias("total"))


@query("x_busdays", f"""SELECT o_orderkey, CAST(len(list_filter(range({D} + 1, DATE '1998-08-02', INTERVAL 1 DAY),
  lambda d: isodow(d) < 6)) AS INT) AS days FROM orders""")
def x_busdays(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", dates.business_days_between(F.to_date("o_orderdate"), "1998-08-02").alias("days"))


@query("x_snowage", f"""{with_sql(TEXT_POSTS)} SELECT doc_id, round(greatest(({NOW_MILLIS}
  - (CAST(post_id AS BIGINT) >> 22)) / 3600000.0::DOUBLE, 0), 6) AS age_hours FROM text_posts""")
def x_snowage(spark, sf_dir):
    return TEXT_POSTS.spark(spark, sf_dir).select(
        "doc_id", F.round(dates.snowflake_age_hours(F.col("post_id"), NOW_MILLIS), 6).alias("age_hours"))


by_row("x_domain", "customer", "c_custkey", [
    "'Shop <news@Mail.' || c_mktsegment || '.example.com>'", "'a.b@x-' || c_custkey || '.org (Bo)'", "'no address'",
    "'Odd <not an address>'"], {
        "mail_domain": ["lower('mail.' || c_mktsegment || '.example.com')", "'x-' || c_custkey || '.org'", "''", "''"]},
    lambda t: {"mail_domain": sender_domain(t)})


@query("x_header", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS subject FROM orders""")
def x_header(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN array(named_struct('name', 'From', 'value', o_orderstatus)) "
        "ELSE array(named_struct('name', 'From', 'value', o_orderstatus), named_struct('name', 'SUBJECT', 'value', "
        "o_orderpriority), named_struct('name', 'subject', 'value', 'second')) END AS headers")
    return df.select("o_orderkey", header(F.col("headers"), "Subject").alias("subject"))


TAGGED = "'#' || replace(replace(replace(text, ' in ', ' #in '), ' the ', ' #the '), ' de ', ' #de ')"


@query("x_hashtags", f"""WITH t AS (SELECT doc_id, regexp_extract_all({TAGGED}, '#([\\pL\\pM\\pN_]+)', 1) AS tags FROM documents)
  SELECT doc_id, array_to_string(list_sort(list_distinct(tags)), ' ') AS distinct_tags, CAST(len(tags) AS INT) AS n FROM t""")
def x_hashtags(spark, sf_dir):
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{TAGGED} AS t")
    return df.select("doc_id", F.array_join(F.array_sort(text.hashtags(F.col("t"), distinct=True)), " ").alias("distinct_tags"),
                     F.size(text.hashtags(F.col("t"))).alias("n"))


by_row("x_jsonlist", "customer", "c_custkey", [
    "'[\"Ann\", \" ' || c_name || ' \", \"\"]'", "'Ann, ' || c_name || ' ,, Bo'", "'[broken, ' || c_name", "''"], {
        "entries": ["'Ann|' || c_name", "'Ann|' || c_name || '|Bo'", "'[broken|' || c_name", "''"]},
    lambda t: {"entries": F.array_join(text.json_or_comma_list(t), "|")})


@query("x_hashkey", """SELECT o_orderkey, substr(sha256('post:' || o_orderkey || ':comment:' || o_orderpriority), 1, 16) AS action_id FROM orders""")
def x_hashkey(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select(
        "o_orderkey", text.stable_key(F.lit("post"), F.col("o_orderkey"), F.lit("comment"), F.col("o_orderpriority")).alias("action_id"))


by_row("x_urn", "customer", "c_custkey", [
    "'urn:li:person:' || c_custkey || '|linkedin.com/in/Cust-' || c_custkey", "'acct-' || c_custkey || '|linkedin.com/in/x'",
    "'|www.linkedin.com/in/U' || c_custkey || '/'", "'urn:li:member:9|'"], {
        "urn": ["'urn:li:member:cust-' || c_custkey", "'acct-' || c_custkey", "'urn:li:member:u' || c_custkey",
                "'urn:li:member:9'"]},
    lambda t: {"urn": people.unified_urn(F.get(F.split(t, r"\|"), F.lit(0)), F.get(F.split(t, r"\|"), F.lit(1)))})


def channel_sql(expr):
    return f"(CASE WHEN {expr}/255.0::DOUBLE <= 0.03928::DOUBLE THEN {expr}/255.0::DOUBLE/12.92::DOUBLE ELSE pow(({expr}/255.0::DOUBLE + 0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END)"


LUM_SQL = (f"(0.2126::DOUBLE * {channel_sql('(p_partkey % 256)')} + 0.7152::DOUBLE * {channel_sql('(p_size % 256)')}"
           f" + 0.0722::DOUBLE * {channel_sql('128')})")


@query("x_contrast", f"""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 1.0::DOUBLE
  ELSE round(1.05::DOUBLE / ({LUM_SQL} + 0.05::DOUBLE), 6) END AS ratio FROM part""")
def x_contrast(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 7 = 0 THEN 'rgba(1, 2, 3, 0)' "
        "ELSE 'rgb(' || (p_partkey % 256) || ', ' || (p_size % 256) || ', 128)' END AS colour")
    return df.select("p_partkey", F.round(numbers.contrast(F.col("colour"), F.lit("rgb(255,255,255)")), 6).alias("ratio"))


FUZZ_SQL = f"""WITH pairs AS (SELECT p_partkey AS id, {fuzz_sql.plain('p_name')} AS a, {fuzz_sql.plain("p_type || ' ' || p_name")} AS b FROM part),
  {fuzz_sql.blended('found', 'pairs')}
  SELECT id AS p_partkey, score AS similarity FROM found"""


@query("x_fuzz", FUZZ_SQL)
def x_fuzz(spark, sf_dir):
    df = spread(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type"))
    scored = fuzz.with_similarity(df, "score", F.col("p_name"), F.concat_ws(" ", "p_type", "p_name"))
    return scored.select("p_partkey", F.round("score", 2).alias("similarity"))


@query("x_rollhash", """SELECT p_partkey, CAST(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(p_name, ''),
  lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: xor(a * 33, b) & 4294967295) % 100000 AS BIGINT) AS h FROM part""")
def x_rollhash(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select(
        "p_partkey", text.rolling_hash(F.col("p_name")).alias("h"))

