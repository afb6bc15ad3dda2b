"""Registered queries: rubrics, comparisons, telemetry, warmth, layout and document checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmetric.operators import documents, evals, layout, proximity, telemetry
from quillmetric.plans.registry import query
from quillmetric.session import spread
from quillmetric.sources.ledger import parse_entries
from quillmetric.tables import LEDGER, STAGES, View, table, with_sql

# ---- rubrics over conversation turns ---------------------------------------------

RUBRIC = ("task_id string, assertion_id string, type string, pattern string, min_words int, max_words int, prompt string, required boolean")
RUBRIC_ROWS = [
    ("assistant", "len", "word_count", None, 10, 200, "length", True),
    ("assistant", "has_the", "regex_match", "\\bthe ", None, None, "mentions", False),
    ("assistant", "no_digits", "regex_disallow", "[0-9]", None, None, "no digits", True),
    ("assistant", "json", "json_valid", None, None, None, "json", False),
    ("user", "placeholder_free", None, None, None, None, "filled", True),
    ("user", "tone", "semantic", None, None, None, "kind tone", None),
    ("system", "brackets", None, None, None, None, "no bracket left", True),
]
RUBRIC_SQL = """WITH o AS (SELECT conv_id * 1000 + turn AS output_id, role AS task_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM conversations),
  w AS (SELECT *, CASE WHEN flat = '' THEN 0 ELSE len(string_split(flat, ' ')) END AS n FROM o),
  r AS (
    SELECT output_id, task_id, 'len' AS assertion_id, true AS required, n BETWEEN 10 AND 200 AS passed, true AS judged FROM w WHERE task_id = 'assistant'
    UNION ALL SELECT output_id, task_id, 'has_the', false, regexp_matches(text, '(?i)\\bthe '), true FROM w WHERE task_id = 'assistant'
    UNION ALL SELECT output_id, task_id, 'no_digits', true, NOT regexp_matches(text, '[0-9]'), true FROM w WHERE task_id = 'assistant'
    UNION ALL SELECT output_id, task_id, 'json', false, json_valid(text), true FROM w WHERE task_id = 'assistant'
    UNION ALL SELECT output_id, task_id, 'placeholder_free', true, NOT regexp_matches(text, '\\[[A-Za-z0-9_\\s]{2,}\\]'), true FROM w WHERE task_id = 'user'
    UNION ALL SELECT output_id, task_id, 'tone', true, true, false FROM w WHERE task_id = 'user'
    UNION ALL SELECT output_id, task_id, 'brackets', true, NOT regexp_matches(text, '\\[[A-Za-z0-9_\\s]{2,}\\]'), true FROM w WHERE task_id = 'system')"""


def judged(spark, sf_dir):
    outputs = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS output_id", "role AS task_id", "text")
    return evals.judge(outputs, spark.createDataFrame(RUBRIC_ROWS, RUBRIC))


@query("j_rubric", f"{RUBRIC_SQL} SELECT * FROM r")
def j_rubric(spark, sf_dir):
    return judged(spark, sf_dir)


@query("c_rubrictype", f"{RUBRIC_SQL} SELECT assertion_id, count(*) AS n, CAST(count_if(passed) AS BIGINT) AS passed FROM r WHERE judged GROUP BY 1")
def c_rubrictype(spark, sf_dir):
    return judged(spark, sf_dir).filter("judged").groupBy("assertion_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"))


@query("a_rubric", f"""{RUBRIC_SQL} SELECT output_id, task_id, count(*) AS assertions, CAST(count_if(passed) AS BIGINT) AS passed,
  round(avg(CASE WHEN passed THEN 100.0::DOUBLE ELSE 0 END), 6) AS pass_rate, bool_or(required AND NOT passed) AS required_failed,
  CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS status FROM r GROUP BY 1, 2""")
def a_rubric(spark, sf_dir):
    return evals.rubric_summary(judged(spark, sf_dir)).withColumn("pass_rate", F.round("pass_rate", 6))


# ---- runs of models: suppliers stand for models, parts for tasks -----------------------

RUNS = View("runs", "lineitem", {
    "model": "l_suppkey", "tier": "CASE l_returnflag WHEN 'A' THEN 'frontier' WHEN 'N' THEN 'mid' ELSE 'compact' END",
    "task": "l_orderkey", "passed": "l_quantity > 12", "latency": "CAST(round(l_extendedprice * 100) AS BIGINT)", "usd": "l_discount",
    "run": "CASE WHEN l_linestatus = 'O' THEN 'base' ELSE 'new' END",
})
MODELS_SQL = f"""{with_sql(RUNS)}, m AS (SELECT model, CAST(count_if(passed) AS BIGINT) AS passes, CAST(sum(latency) AS BIGINT) AS latency,
  CAST(sum(CAST(round(usd * 100) AS BIGINT)) AS BIGINT) AS cents FROM runs GROUP BY 1)"""


@query("a_pareto", f"""{MODELS_SQL} SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.passes >= a.passes AND b.latency <= a.latency AND b.cents <= a.cents
  AND (b.passes > a.passes OR b.latency < a.latency OR b.cents < a.cents))""")
def a_pareto(spark, sf_dir):
    models = RUNS.spark(spark, sf_dir).groupBy("model").agg(
        F.count_if("passed").alias("passes"), F.sum("latency").alias("latency"), F.sum(F.round(F.col("usd") * 100).cast("bigint")).alias("cents"))
    return evals.pareto(models, ["passes"], ["latency", "cents"])


@query("a_inversion", f"""{with_sql(RUNS)} SELECT task FROM runs GROUP BY 1
  HAVING bool_or(CASE WHEN tier <> 'frontier' THEN passed END) AND NOT bool_or(CASE WHEN tier = 'frontier' THEN passed END)""")
def a_inversion(spark, sf_dir):
    return evals.tier_inversions(RUNS.spark(spark, sf_dir), "task", "tier", "passed", "frontier")


@query("a_regression", f"""{with_sql(RUNS)}, a AS (SELECT task, avg(passed::INT::DOUBLE) AS r FROM runs WHERE run = 'base' GROUP BY 1),
  b AS (SELECT task, avg(passed::INT::DOUBLE) AS r FROM runs WHERE run = 'new' GROUP BY 1), j AS (SELECT coalesce(a.task, b.task) AS task, a.r AS ar, b.r AS br FROM a FULL JOIN b USING (task))
  SELECT count(*) AS tasks, CAST(count_if(NOT coalesce(br >= ar, ar IS NULL)) AS BIGINT) AS worse, CAST(count_if(task IN (1, 2, 3) AND coalesce(ar < 1 AND br >= 1, false)) AS BIGINT) AS targets_fixed,
    bool_and(coalesce(br >= ar, ar IS NULL)) AND CAST(count_if(task IN (1, 2, 3) AND coalesce(ar < 1 AND br >= 1, false)) AS BIGINT) = 3 AS gate_passed FROM j""")
def a_regression(spark, sf_dir):
    runs = RUNS.spark(spark, sf_dir)
    return evals.regression_gate(runs.filter("run = 'base'"), runs.filter("run = 'new'"), "task", "passed", [1, 2, 3])


@query("a_traces", """WITH s AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS failed, i, ['search', 'fetch', CASE WHEN o_orderkey % 2 = 0 THEN 'fetch' ELSE 'write' END][i] AS tool,
    CASE WHEN (o_orderkey + i) % 3 = 0 THEN 'invalid_arguments' WHEN (o_orderkey + i) % 7 = 0 THEN 'timeout' END AS error, (o_custkey * i) % 4000 AS ms
    FROM orders, range(1, 4) t(i)), p AS (SELECT *, lag(tool) OVER w = tool AND lag(error) OVER w IS NOT NULL AS retry FROM s WINDOW w AS (PARTITION BY id ORDER BY i)),
  g AS (SELECT id, tool, count(*) AS calls, CAST(count_if(error = 'invalid_arguments') AS BIGINT) AS inv, CAST(count_if(coalesce(retry, false)) AS BIGINT) AS retries, bool_or(failed) AS failed, bool_or(ms > 3000) AS slow FROM p GROUP BY ALL)
  SELECT tool, CAST(sum(calls) AS BIGINT) AS calls, round(sum(inv)::DOUBLE / sum(calls)::DOUBLE, 6) AS invalid_rate, CAST(sum(retries) AS BIGINT) AS retries, CAST(count_if(failed) AS BIGINT) AS failed_runs, CAST(count_if(slow) AS BIGINT) AS slow_runs FROM g GROUP BY 1""")
def a_traces(spark, sf_dir):
    def step(i, tool):
        return (f"named_struct('tool', {tool}, 'error', CASE WHEN (o_orderkey + {i}) % 3 = 0 THEN 'invalid_arguments' WHEN (o_orderkey + {i}) % 7 = 0 THEN 'timeout' END, "
                f"'ms', (o_custkey * {i}) % 4000)")
    traces = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS trace_id", "o_orderstatus = 'F' AS failed",
        f"array({step(1, chr(39) + 'search' + chr(39))}, {step(2, chr(39) + 'fetch' + chr(39))}, {step(3, 'CASE WHEN o_orderkey % 2 = 0 THEN ' + repr('fetch') + ' ELSE ' + repr('write') + ' END')}) AS step_history")
    return evals.mine_traces(traces, 3000).withColumn("invalid_rate", F.round("invalid_rate", 6))


RATINGS = ("['1','2','3','4','5','U','x'][1 + o_orderkey % 6]", "['1','2','3','4','5','U','x'][1 + o_custkey % 5]",
           "CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE ['1','2','3','4','5','u'][1 + o_orderkey % 4] END", "'3'", "CASE WHEN o_orderkey % 9 = 0 THEN 'u' ELSE '5' END")


@query("a_weighted", f"""WITH r AS (SELECT o_orderkey, [{', '.join(RATINGS)}] AS v FROM orders),
  f AS (SELECT o_orderkey, v, len(list_filter(v, lambda x: x = 'x')) = 0 AS valid,
    list_sum(list_transform(v, lambda x, i: coalesce(try_cast(x AS INT), 1) * [6, 5, 4, 3, 2][i])) AS lo,
    list_sum(list_transform(v, lambda x, i: coalesce(try_cast(x AS INT), 5) * [6, 5, 4, 3, 2][i])) AS hi,
    array_to_string(list_filter(list_transform(v, lambda x, i: CASE WHEN upper(x) = 'U' THEN ['fit', 'access', 'interest', 'terms', 'timing'][i] END), lambda x: x IS NOT NULL), ',') AS open_names FROM r)
  SELECT o_orderkey, valid, CAST(CASE WHEN valid THEN lo END AS INT) AS minimum, CAST(CASE WHEN valid THEN hi END AS INT) AS maximum,
    CASE WHEN valid THEN open_names END AS unknown, CASE WHEN valid THEN CASE WHEN open_names = '' THEN 'exact' ELSE 'provisional' END END AS kind,
    CAST(CASE WHEN valid THEN (lo + hi) // 2 END AS INT) AS midpoint FROM f""")
def a_weighted(spark, sf_dir):
    parts = [r.replace("['1','2','3','4','5','U','x'][1 + ", "element_at(array('1','2','3','4','5','U','x'), CAST(1 + ").replace(
        "['1','2','3','4','5','u'][1 + ", "element_at(array('1','2','3','4','5','u'), CAST(1 + ").replace("]", " AS INT))") for r in RATINGS]
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"array({', '.join(parts)}) AS v")
    return evals.opportunity_scores(df, "v").select("o_orderkey", "valid", "minimum", "maximum", "unknown", "kind", "midpoint")


@query("a_fitcard", """WITH s AS (SELECT p_partkey, (p_partkey % 5 + 1) / 5.0::DOUBLE * 25 + (p_size % 5 + 1) / 5.0::DOUBLE * 20 + (p_partkey % 4 + 1) / 5.0::DOUBLE * 20 + 4 / 5.0::DOUBLE * 20
    + (p_size % 3 + 3) / 5.0::DOUBLE * 10 + 1 / 5.0::DOUBLE * 5 AS t FROM part)
  SELECT p_partkey, round(t, 6) AS fit_score, CASE WHEN round(t, 9) >= 85 THEN 'Adopt' WHEN round(t, 9) >= 70 THEN 'Adopt with edits' WHEN round(t, 9) >= 55 THEN 'Trial'
    WHEN round(t, 9) >= 40 THEN 'Fork / rewrite' ELSE 'Reject' END AS decision FROM s""")
def a_fitcard(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 5 + 1 AS fit", "p_size % 5 + 1 AS portability", "p_partkey % 4 + 1 AS quality",
                                                 "4 AS safety", "p_size % 3 + 3 AS maintainability", "1 AS docs")
    return evals.fit_cards(df).select("p_partkey", F.round("fit_score", 6).alias("fit_score"), "decision")


@query("a_funnel", f"""{with_sql(STAGES)}, f AS (SELECT source, segment, true AS seen, state <> 'researching' AS applied, state IN ('networking', 'interviewing') AS replied, state = 'interviewing' AS interviewed FROM stages),
  g AS (SELECT 'all' AS k, 'all' AS v, * FROM f UNION ALL SELECT 'source', source, * FROM f UNION ALL SELECT 'segment', segment, * FROM f),
  c AS (SELECT k, v, CAST(count_if(seen) AS BIGINT) AS a, CAST(count_if(applied) AS BIGINT) AS b, CAST(count_if(replied) AS BIGINT) AS c, CAST(count_if(interviewed) AS BIGINT) AS d FROM g GROUP BY ALL)
  SELECT k AS segment_kind, v AS segment, CAST(i AS INT) AS step, ['seen', 'applied', 'replied', 'interviewed'][i + 1] AS stage, [a, b, c, d][i + 1] AS numerator, [a, a, b, c][i + 1] AS denominator FROM c, range(4) t(i)""")
def a_funnel(spark, sf_dir):
    df = STAGES.spark(spark, sf_dir).selectExpr("source", "segment", "true AS seen", "state <> 'researching' AS applied",
                                                "state IN ('networking', 'interviewing') AS replied", "state = 'interviewing' AS interviewed")
    return evals.funnel(df, ["seen", "applied", "replied", "interviewed"], ["source", "segment"]).drop("rate")


@query("a_cost", f"""{with_sql(RUNS)} SELECT model, tier AS engine, CAST(sum(CAST(usd AS DECIMAL(18,6))) AS DOUBLE) AS usd, count(*) AS runs FROM runs GROUP BY ALL""")
def a_cost(spark, sf_dir):
    log = RUNS.spark(spark, sf_dir).withColumnRenamed("tier", "engine")
    return evals.cost_summary(log).withColumn("usd", F.col("usd").cast("double"))


@query("a_cost_total", f"""{with_sql(RUNS)} SELECT CAST(coalesce(sum(CAST(usd AS DECIMAL(18,6))), 0) AS DOUBLE) AS total_usd FROM runs""")
def a_cost_total(spark, sf_dir):
    return evals.cost_total(RUNS.spark(spark, sf_dir)).select(F.col("total_usd").cast("double").alias("total_usd"))


# ---- ledger --------------------------------------------------------------------------

TITLES = {"error": "Retry later", "signup": "Check form"}


@query("a_ledger", f"""{with_sql(LEDGER)} SELECT CASE WHEN category = 'view' THEN 'GENERIC_TOOL_FAILURE' ELSE category END AS category, count(*) AS failures,
  CASE category WHEN 'error' THEN 'Retry later' WHEN 'signup' THEN 'Check form' END AS rule_title FROM ledger GROUP BY ALL""")
def a_ledger(spark, sf_dir):
    df = LEDGER.spark(spark, sf_dir).withColumn("category", F.expr("CASE WHEN category <> 'view' THEN category END"))
    return telemetry.category_counts(df, TITLES)


@query("a_ledger_programs", """SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'tool' || user_id ELSE 'run' || (user_id % 20) END AS program FROM events WHERE event_type = 'error' AND event_id % 3 < 2""")
def a_ledger_programs(spark, sf_dir):
    lines = table(spark, sf_dir, "events").selectExpr(
        "to_json(named_struct('category', CASE WHEN event_type = 'error' THEN 'MISSING_BINARY' ELSE event_type END, 'fix', CASE WHEN event_id % 3 = 0 THEN "
        "'Binary ''tool' || user_id || ''' was not found' ELSE '' END, 'command', CASE WHEN event_id % 3 = 1 THEN ' run' || (user_id % 20) || ' --x' ELSE '' END)) AS value")
    return telemetry.missing_programs(parse_entries(lines))


STREAK_SQL = f"""{with_sql(LEDGER)}, g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS grp FROM ledger),
  s AS (SELECT event_id, session_id, CAST(sum(failed::INT) OVER (PARTITION BY session_id, grp ORDER BY ts, event_id) AS INT) AS streak FROM g)"""


def streaks(spark, sf_dir):
    return telemetry.failure_streaks(LEDGER.spark(spark, sf_dir), ["session_id"], "ts", "event_id", "failed", F.date_trunc("day", "ts"))


@query("w_streak", f"{STREAK_SQL} SELECT event_id, session_id, streak, streak >= 2 AS deny_next FROM s")
def w_streak(spark, sf_dir):
    return telemetry.with_breaker(streaks(spark, sf_dir)).select("event_id", "session_id", "streak", "deny_next")


# ---- warmth ------------------------------------------------------------------------------

PATHS = View("paths", "lineitem", {
    "contact_id": "l_orderkey", "path_id": "l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey", "name": "'S' || l_suppkey",
    "overlapping_tenure": "l_quantity > 30", "shared_company": "l_quantity > 15", "former_manager": "l_returnflag = 'A'",
    "staff_or_lead": "l_linestatus = 'O'", "shared_cohort": "l_discount > 0.05", "domain_peer": "l_tax > 0.03", "recently_active": "l_partkey % 2 = 0",
})
PATH_SQL = f"""{with_sql(PATHS)}, q AS (SELECT *, least(100, CASE WHEN overlapping_tenure THEN 40 WHEN shared_company THEN 20 ELSE 0 END
    + CASE WHEN former_manager THEN 25 WHEN staff_or_lead THEN 15 ELSE 0 END + CASE WHEN shared_cohort THEN 20 ELSE 0 END + CASE WHEN domain_peer THEN 10 ELSE 0 END
    + CASE WHEN recently_active THEN 5 ELSE 0 END) AS total_q FROM paths),
  r AS (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY total_q DESC, path_id) AS rn, count(*) OVER (PARTITION BY contact_id) AS n FROM q),
  a AS (SELECT contact_id, max(n) AS n, max(CASE rn WHEN 1 THEN total_q END) AS q1, max(CASE rn WHEN 2 THEN total_q END) AS q2, max(CASE rn WHEN 3 THEN total_q END) AS q3,
    max(CASE rn WHEN 1 THEN name END) AS best_name FROM r GROUP BY 1),
  p AS (SELECT o_orderkey AS contact_id, o_orderstatus, o_custkey, best_name, coalesce(n, 0) AS n_paths, CAST(CASE WHEN n IS NULL THEN 0 ELSE least(100, round_even(
      CASE n WHEN 1 THEN q1::DOUBLE WHEN 2 THEN 0.75::DOUBLE * q1 + 0.25::DOUBLE * q2 ELSE 0.7::DOUBLE * q1 + 0.2::DOUBLE * q2 + 0.1::DOUBLE * q3 END + CASE WHEN n >= 10 THEN 10 WHEN n >= 6 THEN 6 WHEN n >= 4 THEN 3 ELSE 0 END, 0)) END AS INT) AS proximity
    FROM orders LEFT JOIN a ON contact_id = o_orderkey)"""


@query("a_pathscore", f"""{PATH_SQL} SELECT path_id, contact_id, CAST(total_q AS INT) AS total_q, CASE WHEN total_q >= 75 THEN 'anchor' WHEN total_q >= 45 THEN 'domain_peer' ELSE 'low_signal' END AS category FROM q""")
def a_pathscore(spark, sf_dir):
    return proximity.path_score(PATHS.spark(spark, sf_dir)).select("path_id", "contact_id", "total_q", "category")


def warm(spark, sf_dir):
    agg = proximity.aggregate_paths(proximity.path_score(PATHS.spark(spark, sf_dir)), "contact_id", "path_id", "name")
    contacts = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS contact_id", "CASE o_orderstatus WHEN 'F' THEN '1st' WHEN 'O' THEN '2nd' ELSE '3rd+' END AS degree",
        "o_custkey % 11 = 0 AS is_friend", "o_custkey % 3 = 0 AS is_teammate", "o_custkey % 5 = 0 AS open_profile", "o_custkey % 7 = 0 AS verified_email")
    df = contacts.join(agg, "contact_id", "left")
    return df.withColumn("proximity", proximity.proximity(F.col("q1"), F.col("q2"), F.col("q3"), F.col("n_paths"), F.lit(0)))


@query("a_proximity", f"{PATH_SQL} SELECT contact_id, n_paths, proximity FROM p")
def a_proximity(spark, sf_dir):
    return warm(spark, sf_dir).select("contact_id", F.coalesce("n_paths", F.lit(0)).cast("bigint").alias("n_paths"), "proximity")


@query("a_tier", f"""{PATH_SQL}, t AS (SELECT *, CASE WHEN o_custkey % 11 = 0 OR (o_orderstatus = 'F' AND o_custkey % 3 = 0) THEN 7 WHEN o_orderstatus = 'F' THEN 6
    WHEN o_orderstatus = 'O' AND proximity >= 75 THEN 6 WHEN o_orderstatus = 'O' AND proximity >= 45 THEN 5 WHEN o_orderstatus = 'O' THEN 4
    WHEN o_custkey % 5 = 0 OR o_custkey % 7 = 0 THEN 3 ELSE 2 END AS warmth_degree,
    CASE WHEN o_custkey % 5 = 0 THEN 'open_profile' ELSE 'email' END AS channel FROM p)
  SELECT contact_id, CAST(warmth_degree AS INT) AS warmth_degree, CASE WHEN warmth_degree >= 6 THEN 'WARM' WHEN warmth_degree >= 4 THEN 'BRIDGE' WHEN warmth_degree = 3 THEN 'COLD' ELSE 'FROZEN' END AS contact_tier,
    best_name, CASE warmth_degree WHEN 7 THEN 'personal_message' WHEN 6 THEN CASE WHEN o_orderstatus = 'F' THEN 'direct_message' ELSE 'ask_introduction: ' || best_name END
      WHEN 5 THEN 'note_naming: ' || best_name WHEN 4 THEN 'note_on_work' WHEN 3 THEN 'sequence_by: ' || channel ELSE 'hold' END AS action,
    CASE warmth_degree WHEN 7 THEN 'knows_personally' WHEN 6 THEN CASE WHEN o_orderstatus = 'F' THEN 'connected' ELSE 'anchor_mutual: ' || best_name END
      WHEN 5 THEN 'peer_mutuals: ' || proximity WHEN 4 THEN 'loose_mutuals: ' || proximity WHEN 3 THEN 'direct_path: ' || channel ELSE 'no_path' END AS rationale FROM t""")
def a_tier(spark, sf_dir):
    return proximity.assess(warm(spark, sf_dir)).select("contact_id", "warmth_degree", "contact_tier", "best_name", "action", "rationale")


# ---- layout ----------------------------------------------------------------------------------

NODES = View("nodes", "lineitem", {
    "snapshot": "l_orderkey", "idx": "l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey",
    "kind": "CASE l_linenumber % 4 WHEN 0 THEN 'button' WHEN 1 THEN 'text' WHEN 2 THEN 'image' ELSE 'box' END",
    "text": "CASE WHEN l_linenumber % 4 = 2 THEN NULL ELSE l_returnflag END",
    "x": "CAST((l_partkey % 3) * 4 AS DOUBLE)", "y": "CAST((l_suppkey % 3) * 3 AS DOUBLE)",
    "w": "CAST(CASE WHEN l_linenumber % 4 = 2 THEN 300 ELSE 100 + l_partkey % 5 END AS DOUBLE)",
    "h": "CAST(CASE WHEN l_linenumber % 4 = 2 THEN 300 ELSE 40 + l_suppkey % 3 END AS DOUBLE)",
    "filled": "l_linestatus = 'O'", "bg": "'rgb(' || (l_partkey % 256) || ',' || (l_suppkey % 200) || ',90)'", "page_bg": "'rgb(255, 255, 255)'",
})
IX = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
OVER_SQL = f"""{with_sql(NODES)}, kept AS (SELECT * FROM nodes b WHERE NOT EXISTS (SELECT 1 FROM nodes a WHERE a.snapshot = b.snapshot AND a.kind = b.kind
  AND coalesce(a.text, '') = coalesce(b.text, '') AND a.idx < b.idx AND {IX} / greatest(1, least(a.w * a.h, b.w * b.h)) >= 0.9))"""


@query("j_overlap", f"{OVER_SQL} SELECT snapshot, idx, kind FROM kept")
def j_overlap(spark, sf_dir):
    return layout.drop_overlays(NODES.spark(spark, sf_dir)).select("snapshot", "idx", "kind")


@query("j_inbox", f"""{with_sql(NODES)}, decor AS (SELECT a.snapshot AS s, a.idx AS i FROM nodes a JOIN nodes b ON a.snapshot = b.snapshot AND b.kind IN ('text', 'heading', 'button')
    AND b.x + b.w / 2 > a.x AND b.x + b.w / 2 < a.x + a.w AND b.y + b.h / 2 > a.y AND b.y + b.h / 2 < a.y + a.h
    WHERE a.kind = 'image' AND a.w * least(a.h, 600 - a.y) >= 600 * 600 * 0.2 GROUP BY a.snapshot, a.idx HAVING count(*) >= 3)
  SELECT snapshot, idx, kind FROM nodes LEFT JOIN decor ON s = snapshot AND i = idx WHERE i IS NULL""")
def j_inbox(spark, sf_dir):
    return layout.drop_decoration(NODES.spark(spark, sf_dir), 600.0, 600.0).select("snapshot", "idx", "kind")


def _lum(r, g, b):
    ch = lambda v: f"(CASE WHEN ({v}) / 255.0::DOUBLE <= 0.03928::DOUBLE THEN ({v}) / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((({v}) / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
    return f"(0.2126::DOUBLE * {ch(r)} + 0.7152::DOUBLE * {ch(g)} + 0.0722::DOUBLE * {ch(b)})"


@query("t_primary", f"""{with_sql(NODES)}, c AS (SELECT *, 1.05::DOUBLE / ({_lum("str_split(bg[5:-2], ',')[1]::INT", "str_split(bg[5:-2], ',')[2]::INT", '90')} + 0.05::DOUBLE) AS ratio FROM nodes
    WHERE kind = 'button' AND filled), s AS (SELECT *, ratio * sqrt(w * h) * CASE WHEN y < 4 THEN 1.5::DOUBLE ELSE 1 END AS score FROM c WHERE ratio >= 1.6)
  SELECT snapshot, idx, round(score, 6) AS button_score FROM s QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY score DESC, idx) = 1""")
def t_primary(spark, sf_dir):
    return layout.primary_buttons(NODES.spark(spark, sf_dir), 4.0).select("snapshot", "idx", F.round("button_score", 6).alias("button_score"))


@query("t_largebox", f"{with_sql(NODES)} SELECT snapshot, idx, w * h AS area FROM nodes WHERE kind = 'box' AND w * h >= 600 * 600 * 0.012")
def t_largebox(spark, sf_dir):
    return layout.large_boxes(NODES.spark(spark, sf_dir), 600.0, 600.0).select("snapshot", "idx", "area")


# ---- documents -----------------------------------------------------------------------------------

README = ("'# ' || source || '\\n**' || substr(replace(text, '\\n', ' '), 1, 30) || '**\\n' || CASE WHEN doc_id % 2 = 0 THEN '![b](https://img.shields.io/b.svg) ![c](http://h' || (doc_id % 7) || '.org/x.png)' ELSE '' END || "
          "'\\n<img width=\"' || CASE WHEN doc_id % 3 = 0 THEN '100%' ELSE '40' END || '\" src=\"https://Img' || doc_id || '.example.com/a.gif\">\\n## Quickstart\\n```bash\\n# not a title {{X' || CASE WHEN doc_id % 5 = 0 THEN '}}' ELSE '}' END || "
          "'\\n```\\n' || CASE WHEN doc_id % 4 = 0 THEN '```mermaid\\n```\\n## License\\n' ELSE '## Notes\\n' END || text")
README_DUCK = README.replace("\\n", "' || chr(10) || '")


def readmes(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{README} AS text")


@query("a_origins", """SELECT doc_id, array_to_string(list_sort(list_filter(['img' || doc_id || '.example.com', CASE WHEN doc_id % 2 = 0 THEN 'img.shields.io' END, CASE WHEN doc_id % 2 = 0 THEN 'h' || (doc_id % 7) || '.org' END],
  lambda x: x IS NOT NULL)), '|') AS origins FROM documents""")
def a_origins(spark, sf_dir):
    return readmes(spark, sf_dir).select("doc_id", F.array_join(documents.image_origins(F.col("text")), "|").alias("origins"))


@query("c_features", f"""WITH d AS (SELECT doc_id, text AS body, {README_DUCK.replace("replace(text, '' || chr(10) || '', ' ')", "replace(text, chr(10), ' ')")} AS t FROM documents)
  SELECT doc_id, CAST(length(t) AS INT) AS chars, CAST(length(t) - length(replace(t, chr(10), '')) + CASE WHEN t[-1] = chr(10) THEN 0 ELSE 1 END AS INT) AS lines, CAST(1 AS INT) AS code_blocks, doc_id % 4 = 0 AS has_diagram, CAST(3 AS INT) AS headings FROM d""")
def c_features(spark, sf_dir):
    return documents.features(readmes(spark, sf_dir), "doc_id").select("doc_id", "chars", "lines", "code_blocks", "has_diagram", "headings")


README_SQL = """WITH t AS (SELECT *, regexp_matches('**' || substr(replace(text, chr(10), ' '), 1, 30) || '**', '^[*]{2}[^*]{10,}[*]{2}') AS tagline FROM documents),
  c AS (SELECT doc_id, tagline, 10 + CASE WHEN tagline THEN 5 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END AS hero, 15 AS quickstart,
    CASE WHEN doc_id % 4 = 0 THEN 10 ELSE 0 END AS visuals, 0 AS craft, CASE WHEN doc_id % 4 = 0 THEN 5 ELSE 0 END AS trust,
    CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 15 ELSE 0 END AS penalties FROM t),
  r AS (SELECT *, CAST(round_even((hero + quickstart + visuals + craft + trust) * 100.0::DOUBLE / 90, 0) AS INT) AS raw_score,
    array_to_string(list_filter([CASE WHEN NOT tagline THEN 'hero.tagline' END, CASE WHEN doc_id % 2 = 1 THEN 'hero.badges' END, 'hero.quick_links',
      'quickstart.two_code_blocks', CASE WHEN doc_id % 4 <> 0 THEN 'visuals.architecture' END, 'visuals.card_table', 'visuals.icons', 'craft.themes', 'craft.alerts',
      'craft.accordions', 'craft.tables', CASE WHEN doc_id % 4 <> 0 THEN 'trust.license' END, CASE WHEN doc_id % 3 = 0 THEN 'guardrail.dimensions' END,
      CASE WHEN doc_id % 5 = 0 THEN 'guardrail.placeholders' END], lambda x: x IS NOT NULL), '|') AS recommendations FROM c)
  SELECT doc_id, hero::INT AS hero, quickstart::INT AS quickstart, visuals::INT AS visuals, craft::INT AS craft, trust::INT AS trust, penalties::INT AS penalties,
    raw_score, CAST(greatest(0, least(100, raw_score - penalties)) AS INT) AS total_score, recommendations FROM r"""


@query("a_readme", README_SQL)
def a_readme(spark, sf_dir):
    return documents.audit_readmes(readmes(spark, sf_dir), "doc_id").withColumn("recommendations", F.array_join("recommendations", "|"))


APP = ("'- Target role: ' || CASE WHEN o_orderkey % 6 = 0 THEN 'TBD' ELSE 'Web  Lead ' || (o_custkey % 40) END || '\\n- Company: Org ' || (o_orderkey % 300) || '\\n' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '- Status: Ready\\n' END || "
       "CASE WHEN o_orderkey % 9 = 0 THEN '- Status: Draft\\n' ELSE '' END || '- Opportunity score: ' || CASE o_orderkey % 5 WHEN 0 THEN '60' WHEN 1 THEN '19' WHEN 2 THEN '40–60 provisional; midpoint 50' WHEN 3 THEN '40–60 provisional; midpoint 51' ELSE 'high' END || "
       "'\\n- Next action: call\\n- Follow-up date: 2024-06-01\\n```\\n## Cover Letter\\n```\\n<!-- ## Application Log ' || CASE WHEN o_orderkey % 7 = 0 THEN '{{GAP}}' ELSE '' END || ' -->\\n## Fit Assessment\\nok' || CASE WHEN o_orderkey % 7 = 1 THEN ' {{GAP}}' WHEN o_orderkey % 7 = 2 THEN ' [fill in]' WHEN o_orderkey % 7 = 3 THEN ' [site](http://x)' ELSE '' END || "
       "'\\n' || CASE WHEN o_orderkey % 3 = 0 THEN '### Cover Letter' WHEN o_orderkey % 3 = 1 THEN '## Cover Letter' ELSE '' END || '\\n- Human moment: User-verified — we met at the fair\\n## Tailored Resume\\n' || CASE o_orderkey % 4 WHEN 0 THEN '###' ELSE '##' || CASE WHEN o_orderkey % 4 = 1 THEN '##' ELSE '#' END END || "
       "' Lead | Emp' || (o_custkey % 9) || ' | ' || CASE WHEN o_orderkey % 8 < 4 THEN 'May 2020–Present' ELSE '2020' END || '\\nBuilt the data platform\\n### a | b |\\n## Application Log\\n| Date | Action | Result | Next step |\\n|---|---|---|---|\\n| 2024-05-0' || CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE '1' END || ' | Sent mail | None yet | Wait a week |\\n'")


def applications(spark, sf_dir):
    orders = spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"))
    docs = orders.selectExpr("o_orderkey", f"{APP} AS text")
    return documents.prepare_applications(docs, "o_orderkey")


@query("c_apphead", """SELECT o_orderkey, 'heading_level: Cover Letter' AS error FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'heading_missing: Cover Letter' FROM orders WHERE o_orderkey % 3 = 2
  UNION ALL SELECT o_orderkey, 'field_missing: Status' FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 9 <> 0
  UNION ALL SELECT o_orderkey, 'field_repeated: Status' FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 9 = 0""")
def c_apphead(spark, sf_dir):
    return documents.heading_errors(applications(spark, sf_dir), "o_orderkey")


@query("c_appscore", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'score_out_of_range'
  WHEN 3 THEN 'score_range_invalid' ELSE 'score_format' END AS error FROM orders WHERE o_orderkey % 5 IN (1, 3, 4)""")
def c_appscore(spark, sf_dir):
    return documents.score_errors(applications(spark, sf_dir), "o_orderkey")


@query("c_appplace", """SELECT o_orderkey, 'open_marker' AS error FROM orders WHERE o_orderkey % 7 IN (1, 2)
  UNION ALL SELECT o_orderkey, 'open_field: target role' FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 4 <> 0""")
def c_appplace(spark, sf_dir):
    return documents.placeholder_errors(applications(spark, sf_dir), "o_orderkey")


@query("c_approle", """SELECT o_orderkey, 'role_parts' AS error FROM orders
  UNION ALL SELECT o_orderkey, 'role_level: Lead' FROM orders WHERE o_orderkey % 4 = 1
  UNION ALL SELECT o_orderkey, 'role_dates: Lead' FROM orders WHERE o_orderkey % 8 >= 4""")
def c_approle(spark, sf_dir):
    return documents.role_errors(applications(spark, sf_dir), "o_orderkey")


@query("c_appready", """WITH r AS (SELECT * FROM orders WHERE o_orderkey % 4 <> 0)
  SELECT o_orderkey, 'ready_without_letter' AS error FROM r WHERE o_orderkey % 3 <> 1
  UNION ALL SELECT o_orderkey, 'ready_without_moment' FROM r WHERE o_orderkey % 3 <> 1
  UNION ALL SELECT o_orderkey, 'ready_without_log' FROM r WHERE o_orderkey % 10 = 0""")
def c_appready(spark, sf_dir):
    return documents.ready_errors(applications(spark, sf_dir), "o_orderkey")


@query("a_dupid", """WITH i AS (SELECT o_orderkey, 'org ' || (o_orderkey % 300) AS company, CASE WHEN o_orderkey % 6 = 0 THEN 'tbd' ELSE 'web lead ' || (o_custkey % 40) END AS role FROM orders)
  SELECT company, role, o_orderkey, count(*) OVER (PARTITION BY company, role) AS documents FROM i QUALIFY documents > 1""")
def a_dupid(spark, sf_dir):
    return documents.duplicate_identities(applications(spark, sf_dir), "o_orderkey").select("company", "role", "o_orderkey", "documents")


@query("c_visible", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 1 THEN 4 ELSE 3 END AS INT) AS sections, o_orderkey % 7 = 1 AS open_marker FROM orders""")
def c_visible(spark, sf_dir):
    df = applications(spark, sf_dir)
    return df.select("o_orderkey", F.size(F.filter("headings", lambda h: h["level"] == 2)).alias("sections"),
                     F.col("visible_text").rlike(r"\{\{.+?\}\}").alias("open_marker"))
