"""Registered queries: prose rules, scrubbing and text checks over whole documents.

The corpus is invented prose, so vocabulary rules run on terms that occur in it; the house lists
are exercised by the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmetric.functions import text
from quillmetric.operators import lint
from quillmetric.plans.registry import ORACLES, query
from quillmetric.session import new_work_path
from quillmetric.sources import sinks
from quillmetric.tables import table

CFG = lint.LintConfig(
    banned_words=("ndon", "esat", "than"), banned_phrases=("of the", "in the"), hype_words=("oure", "stupid"),
    openers=("is and", "the", "la"), claim=r"\b(estion|ndat|ated)\b", evidence=r"(\d|\bntea\b|\bthe\b)",
    claim_label=r"\b(atou|of)\b", thesis=r"\b(whon|enst)\b", promise=r"\b(stes|athe)\b",
    shame=r"\b(stupid|worthless|loser|lazy)\b", dash_chars="|%", max_dashes=2, max_paragraph_words=120)

# Lines of a document with their number, as the check database sees them.
LINES_SQL = r"""WITH cut AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r]') AS ls FROM documents),
  raw AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INT) AS line, unnest(ls) AS raw FROM cut),
  prose AS (SELECT doc_id, line, raw FROM raw
    WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '>') AND NOT starts_with(trim(raw), '<!--')),
  lines AS (SELECT doc_id, line, trim(regexp_replace(regexp_replace(raw, '^\s{0,3}([-*+]|\d+[.)])\s+', ''),
    '^\s{0,3}#{1,6}\s+', '')) AS t FROM prose),
  vis AS (SELECT * FROM lines WHERE t <> '')"""
EDGE_L, EDGE_R = r"(^|[^\pL\pM\pN_])", r"([^\pL\pM\pN_]|$)"
SENTS_SQL = LINES_SQL + r""", sents AS (SELECT doc_id, line, pos, trim(s) AS s FROM (
    SELECT doc_id, line, generate_subscripts(p, 1) AS pos, unnest(p) AS s FROM (SELECT doc_id, line,
      string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9"“‘])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM vis))
    WHERE trim(s) <> ''),
  counted AS (SELECT *, CAST(len(regexp_extract_all(s, '[A-Za-z0-9]+([''’\-][A-Za-z0-9]+)*')) AS INT) AS words FROM sents)"""


def words_sql(rule, label, terms):
    listed = ", ".join(f"('{t}')" for t in terms)
    return f"""{LINES_SQL}, terms(term) AS (VALUES {listed})
      SELECT doc_id, '{rule}' AS rule, line, '{label}: ' || term AS message FROM vis, terms
      WHERE regexp_matches(lower(t), '{EDGE_L}' || term || '{EDGE_R}')"""


def matches(words):
    return f"regexp_matches(lower(t), '{EDGE_L}({words}){EDGE_R}')"


def run_rule(spark, sf_dir, *rules):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return lint.lint(docs, rules=rules, cfg=CFG)


SEVERITY_SQL = "CASE WHEN rule IN ('W007', 'W008', 'W009') THEN 'info' WHEN rule >= 'W011' THEN 'review' ELSE 'warning' END"
ADVICE_SQL = "CASE rule " + " ".join(f"WHEN '{rule}' THEN '{advice}'" for rule, advice in lint.SUGGESTIONS.items()) + " END"


def line_rule(key, rule, sql):
    @query(key, f"SELECT *, {SEVERITY_SQL} AS severity, {ADVICE_SQL} AS suggestion FROM ({sql})")
    def run(spark, sf_dir):
        return run_rule(spark, sf_dir, rule).select("doc_id", "rule", "severity", "line", "message", "suggestion")
    return run


line_rule("c_w001", "W001", words_sql("W001", "inflated word", CFG.banned_words))
line_rule("c_w002", "W002", f"""{LINES_SQL}, terms(term) AS (VALUES ('of the'), ('in the'))
  SELECT doc_id, 'W002' AS rule, line, 'worn phrase: ' || term AS message
  FROM vis, terms WHERE contains(lower(t), term)""")
line_rule("c_w003", "W003", f"""{LINES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn FROM vis)
  SELECT doc_id, 'W003' AS rule, line, 'slow opening' AS message FROM f
  WHERE rn = 1 AND regexp_matches(lower(t), '^(is and|the|la){EDGE_R}')""")
line_rule("c_w004", "W004", """SELECT doc_id, 'W004' AS rule, CAST(NULL AS INT) AS line,
  'dashes: ' || (length(text) - length(replace(replace(text, '|', ''), '%', ''))) AS message
  FROM documents WHERE length(text) - length(replace(replace(text, '|', ''), '%', '')) > 2""")
line_rule("c_w005", "W005", f"""{LINES_SQL} SELECT doc_id, 'W005' AS rule, line,
  'exclamation mark' AS message FROM vis WHERE contains(t, '!')""")
line_rule("c_w006", "W006", f"""{SENTS_SQL} SELECT doc_id, 'W006' AS rule, line,
  'long sentence: ' || words AS message FROM counted WHERE words > 45""")
CADENCE_SQL = f"""{SENTS_SQL}, w AS (SELECT doc_id, line, pos,
    max(words) OVER r - min(words) OVER r AS spread, count(*) OVER r AS n FROM counted
    WINDOW r AS (PARTITION BY doc_id ORDER BY line, pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) AS rn FROM w WHERE n = 5 AND spread <= 5)"""
line_rule("c_w007", "W007", f"""{CADENCE_SQL} SELECT doc_id, 'W007' AS rule, line,
  'even sentence lengths' AS message FROM f WHERE rn = 1""")


@query("w_cadence", f"{CADENCE_SQL} SELECT doc_id, line AS last_line FROM f WHERE rn = 1")
def w_cadence(spark, sf_dir):
    return run_rule(spark, sf_dir, "W007").select("doc_id", F.col("line").alias("last_line"))


# No document has a blank line, so one document is one paragraph here.
PARA_SQL = f"""{LINES_SQL}, paras AS (SELECT doc_id, CAST(min(line) AS INT) AS line, string_agg(t, ' ' ORDER BY line) AS p,
    count(*) AS n_lines FROM lines GROUP BY doc_id),
  pw AS (SELECT *, len(regexp_extract_all(p, '[A-Za-z0-9]+([''’\\-][A-Za-z0-9]+)*')) AS words,
    len(list_filter(string_split_regex(p, '[^\\pL\\pM\\pN_]+'),
      lambda w: regexp_full_match(w, '[A-Za-z]+(tion|ment|ance|ence|ity|ness|ship)'))) AS noms FROM paras)"""
line_rule("c_w008", "W008", f"""{PARA_SQL} SELECT doc_id, 'W008' AS rule, line,
  'long paragraph: ' || words AS message FROM pw JOIN documents USING (doc_id)
  WHERE words > 120 AND n_lines = 1 AND NOT regexp_matches(text, '(?m)^\\s*([-*+]|\\d+[.)])\\s+')""")
line_rule("c_w009", "W009", f"""{PARA_SQL} SELECT doc_id, 'W009' AS rule, line,
  'many abstract nouns: ' || noms AS message FROM pw
  WHERE words >= 40 AND noms >= 5 AND noms / words > 0.08""")
line_rule("c_w010", "W010", words_sql("W010", "hype word", CFG.hype_words))
CLAIM_SQL = f"{matches('estion|ndat|ated')} AND NOT (regexp_matches(t, '\\d') OR {matches('ntea')} OR {matches('the')})"
line_rule("c_w011", "W011", f"""{LINES_SQL} SELECT doc_id, 'W011' AS rule, line,
  'claim without evidence' AS message FROM vis WHERE {CLAIM_SQL}""")
line_rule("c_w012", "W012", f"""{LINES_SQL} SELECT doc_id, 'W012' AS rule, line,
  'claim without label' AS message FROM vis WHERE {CLAIM_SQL} AND NOT {matches('atou|of')}""")

NOTED_SQL = """(SELECT doc_id, '<!-- canonical-terms: ' || CASE WHEN doc_id % 2 = 0 THEN 'Founder, website' ELSE 'workflow' END
  || ' -->' || chr(10) || replace(replace(replace(text, ' of ', ' founder '), ' is ', ' entrepreneur '), ' in ', ' process ')
  || CASE WHEN doc_id % 3 = 0 THEN ' workflow' ELSE '' END AS text FROM documents)"""


@query("c_w013", f"""WITH d AS {NOTED_SQL}, a(term, alias, part) AS (VALUES ('founder', 'entrepreneur', 0),
    ('founder', 'business owner', 0), ('website', 'site', 0), ('website', 'web presence', 0),
    ('workflow', 'process', 1), ('workflow', 'pipeline', 1))
  SELECT doc_id, 'W013' AS rule, CAST(NULL AS INT) AS line,
    'shifting term: ' || term || ' to ' || alias AS message
  FROM d, a WHERE doc_id % 2 = part AND regexp_matches(lower(text), '{EDGE_L}' || term || '{EDGE_R}')
    AND regexp_matches(lower(text), '{EDGE_L}' || alias || '{EDGE_R}')""")
def c_w013(spark, sf_dir):
    noted = table(spark, sf_dir, "documents", "doc_id", "text").selectExpr(
        "doc_id", NOTED_SQL.split("SELECT doc_id, ", 1)[1].rsplit(" AS text FROM", 1)[0] + " AS text")
    return lint.lint(noted, rules=["W013"]).select("doc_id", "rule", "line", "message")


OPENING_SQL = f"""{LINES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn,
    count(*) OVER (PARTITION BY doc_id) AS total FROM vis),
  side AS (SELECT *, rn <= greatest(1, (total + 4) // 5) AS is_open FROM n WHERE total >= 8),
  f AS (SELECT doc_id, CAST(min(CASE WHEN NOT is_open THEN line END) AS INT) AS line,
    bool_or(is_open AND {matches('whon|enst')}) AS thesis,
    bool_or(NOT is_open AND {matches('estion|ndat|ated')}) AS claim FROM side GROUP BY doc_id)"""
line_rule("c_w014", "W014", f"""{OPENING_SQL} SELECT doc_id, 'W014' AS rule, line,
  'late thesis' AS message FROM f WHERE claim AND NOT thesis""")


@query("w_opening", f"{OPENING_SQL} SELECT doc_id, line AS first_later_line FROM f WHERE claim AND NOT thesis")
def w_opening(spark, sf_dir):
    return run_rule(spark, sf_dir, "W014").select("doc_id", F.col("line").alias("first_later_line"))


line_rule("c_w015", "W015", f"""{LINES_SQL} SELECT doc_id, 'W015' AS rule, line, 'large promise: '
  || regexp_extract(t, '(?i){EDGE_L}(stes|athe){EDGE_R}', 2) AS message FROM vis WHERE {matches('stes|athe')}""")
line_rule("c_w016", "W016", f"""{LINES_SQL} SELECT doc_id, 'W016' AS rule, line,
  'shaming word' AS message FROM vis WHERE {matches('stupid|worthless|loser|lazy')}""")

# Every rule over every document; W013 counts the documents as they are, without a note of canonical terms.
COUNTED = tuple(f"c_w{n:03d}" for n in range(1, 17) if n != 13)
COUNT_SQL = "WITH found AS (" + " UNION ALL ".join(f"SELECT doc_id, rule FROM ({ORACLES[key]})" for key in COUNTED) + ")"



@query("a_rulecount", f"{COUNT_SQL} SELECT rule, {SEVERITY_SQL} AS severity, count(*) AS findings FROM found GROUP BY ALL")
def a_rulecount(spark, sf_dir):
    return lint.rule_counts(run_rule(spark, sf_dir, *lint.SEVERITY))


@query("k_findings", f"{COUNT_SQL} SELECT count(*) AS findings, false AS failed FROM found")
def k_findings(spark, sf_dir):
    out = new_work_path(spark, "findings")
    failed = sinks.write_findings(run_rule(spark, sf_dir, *lint.SEVERITY), out)
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("findings")).withColumn("failed", F.lit(failed))


FENCED = "replace(replace(text, '. ', '.' || chr(10)), ' is ', chr(10) || '```' || chr(10))"


@query("w_fence", f"""WITH cut AS (SELECT doc_id, string_split_regex({FENCED}, '\\r\\n|[\\n\\r]') AS ls FROM documents),
  raw AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INT) AS line, unnest(ls) AS raw FROM cut),
  m AS (SELECT *, CASE WHEN starts_with(trim(raw), '```') OR starts_with(trim(raw), '~~~') THEN 1 ELSE 0 END AS fence FROM raw),
  s AS (SELECT *, sum(fence) OVER (PARTITION BY doc_id ORDER BY line) AS fences FROM m)
  SELECT doc_id, count(*) AS prose_lines, CAST(sum(line) AS BIGINT) AS line_sum FROM s
  WHERE fence = 0 AND fences % 2 = 0 AND trim(raw) <> '' AND NOT starts_with(trim(raw), '>')
    AND NOT starts_with(trim(raw), '<!--') GROUP BY doc_id""")
def w_fence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text").selectExpr("doc_id", f"{FENCED} AS text")
    df = docs.select("doc_id", lint.prose_lines(F.col("text")).alias("p")).filter(F.size("p") > 0)
    total = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["line"])
    return df.select("doc_id", F.size("p").cast("bigint").alias("prose_lines"), total.alias("line_sum"))


REPEAT_SQL = r"""WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
  raw AS (SELECT doc_id, generate_subscripts(ls, 1) AS line, trim(unnest(ls)) AS t FROM cut),
  kept AS (SELECT * FROM raw WHERE t <> '' AND NOT regexp_full_match(t, '\d+') AND NOT regexp_matches(t, '^\d{2}:\d{2}:\d{2}')),
  bare AS (SELECT doc_id, line, regexp_replace(t, '<[^>]+>', '', 'g') AS t FROM kept),
  lagged AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY line), '') AS before FROM bare)"""


@query("s_transcript", REPEAT_SQL + r""" SELECT doc_id, regexp_replace(string_agg(t, ' ' ORDER BY line), '\s+', ' ', 'g') AS prose
  FROM lagged WHERE t <> before GROUP BY doc_id""")
def s_transcript(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", lint.clean_transcript(F.col("text")).alias("prose"))


@query("w_repeatline", REPEAT_SQL + " SELECT doc_id, count(*) AS dropped FROM lagged WHERE t = before GROUP BY doc_id")
def w_repeatline(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n", -1), text.strip),
                     lambda x: (x != "") & ~x.rlike(r"^\d+$") & ~x.rlike(r"^\d{2}:\d{2}:\d{2}"))
    df = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", lines.alias("l"))
    dropped = F.size("l") - F.size(lint.drop_repeats(F.col("l")))
    return df.select("doc_id", dropped.cast("bigint").alias("dropped")).filter("dropped > 0")


RISK_TERMS = ("stupid", "password", "license", "the th", "token", "|")


@query("f_risk", """SELECT doc_id, term AS pattern FROM documents, (VALUES ('stupid'), ('password'), ('license'),
  ('the th'), ('token'), ('|')) AS t(term) WHERE contains(lower(text), term)""")
def f_risk(spark, sf_dir):
    return lint.risk_flags(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", RISK_TERMS)


@query("x_scrub", r"""SELECT doc_id, source, replace(replace(regexp_replace(regexp_replace(text,
    '[\pL\pM\pN_.+-]+@[\pL\pM\pN_-]+\.[\pL\pM\pN_.-]+', '[email]', 'g'),
    '\+\d[\d\-. ()]{8,}\d|\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}', '[number]', 'g'), '—', '-'), '–', '-') AS scrubbed
  FROM documents""")
def x_scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        "doc_id", "source", text.scrub_placeholders(F.col("text")).alias("scrubbed"))


@query("x_scrub_blank", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text,
    '[\pL\pM\pN_.+-]+@[\pL\pM\pN_-]+(\.[\pL\pM\pN_-]+)+', '', 'g'),
    '(^|[^\pL\pM\pN_/])\+?\d[\d\s().-]{8,}\d($|[^\pL\pM\pN_/])', '\1\2', 'g'), '\s{2,}', ' ', 'g')) AS scrubbed FROM documents""")
def x_scrub_blank(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", text.scrub_blank(F.col("text")).alias("scrubbed"))


@query("x_length", "SELECT doc_id, CAST(length(text) AS INT) AS n, length(text) <= 2000 AS within FROM documents")
def x_length(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", text.code_points(F.col("text")).alias("n"), text.within_limit(F.col("text"), 2000).alias("within"))


MARKED = "'**' || substr(text, 1, 20) || '** [see ' || source || '](http://x/' || doc_id || ') `' || lang || '` ' || text"


@query("x_markup", f"""SELECT doc_id, trim(replace(replace(regexp_replace({MARKED}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'),
  '**', ''), '`', '')) AS plain FROM documents""")
def x_markup(spark, sf_dir):
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{MARKED} AS t")
    return df.select("doc_id", text.strip_markup(F.col("t")).alias("plain"))


OUTREACH = "replace(text, ' is ', ' is just following up ') || chr(10) || '### Connection Request Note' || chr(10) || '> ' || source || ' ' || replace(text, chr(10), ' ') || chr(10) || '## End'"
OUTREACH_DUCK = OUTREACH


@query("c_outreach", f"""WITH d AS (SELECT doc_id, text AS body, source, {OUTREACH_DUCK} AS text FROM documents),
  cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
  raw AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INT) AS line, unnest(ls) AS raw FROM cut)
  SELECT doc_id, 'dash' AS kind, line, '%' AS detail FROM raw WHERE contains(raw, '%')
  UNION ALL SELECT doc_id, 'phrase', line, 'just following up' FROM raw WHERE contains(raw, 'is just following up ')
  UNION ALL SELECT doc_id, 'note', CAST(length(body) - length(replace(body, chr(10), '')) + 2 AS INT),
    CAST(length(trim(source || ' ' || replace(body, chr(10), ' '))) AS VARCHAR)
  FROM d WHERE length(trim(source || ' ' || replace(body, chr(10), ' '))) > 200""")
def c_outreach(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{OUTREACH} AS text")
    return lint.outreach_findings(docs, long_dash="%")
