"""Registered queries: streams run to the end of what is there, and keyword targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmetric.operators import targets
from quillmetric.plans.eval_queries import STREAK_SQL
from quillmetric.plans.registry import query
from quillmetric.session import new_work_path
from quillmetric.streaming import jobs, stateful
from quillmetric.tables import STAGES, table, with_sql


def stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return jobs.file_stream(spark, sf_dir, f"{name}.parquet", schema)


BATCHES = 3


def in_batches(spark, sf_dir, work, run):
    """Feed the events in order of their ids, a third at a time, to ``run(stream)``: each third is one micro-batch."""
    events = table(spark, sf_dir, "events")
    top = events.agg(F.max("event_id").alias("top")).first()["top"] or 0
    size = top // BATCHES + 1
    for n in range(BATCHES):
        events.filter((F.col("event_id") >= n * size) & (F.col("event_id") < (n + 1) * size)).write.mode("append").parquet(f"{work}/in")
        run(jobs.file_stream(spark, f"{work}/in", "*.parquet", events.schema))


@query("r_listen", "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen FROM events")
def r_listen(spark, sf_dir):
    work = new_work_path(spark, "listen")
    events = stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    seen = jobs.first_seen(jobs.captures(events, "ts"), "ts", "event_id")
    jobs.run_to_end(seen.select("event_id", "user_id", "ts"), f"{work}/out", f"{work}/checkpoint")
    done = spark.read.schema("event_id bigint, user_id bigint, ts timestamp").parquet(f"{work}/out")
    return done.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query("r_listen_windows", """WITH w AS (SELECT event_id, epoch_us(ts) // 8000000 AS n, epoch_us(ts) % 8000000 AS o FROM events)
  SELECT CAST(1 + CASE WHEN o < 2000000 THEN 1 ELSE 0 END AS BIGINT) AS windows, count(*) AS posts FROM w GROUP BY 1""")
def r_listen_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    per = jobs.captures(events, "ts").groupBy("event_id").agg(F.count(F.lit(1)).alias("windows"))
    return per.groupBy("windows").agg(F.count(F.lit(1)).alias("posts"))


@query("r_heartbeat", """SELECT 'posts' AS kind, count(DISTINCT event_id) AS total FROM events UNION ALL SELECT 'authors', count(DISTINCT user_id) FROM events
  UNION ALL SELECT 'tabs', count(DISTINCT event_type) FROM events""")
def r_heartbeat(spark, sf_dir):
    work = new_work_path(spark, "heartbeat")
    jobs.running_counts(stream(spark, sf_dir, "events"), {"posts": F.col("event_id"), "authors": F.col("user_id"), "tabs": F.col("event_type")},
                        f"{work}/checkpoint", f"{work}/added")
    return jobs.counts_so_far(spark, f"{work}/added")


@query("r_heartbeat_sketched", """SELECT 'posts' AS kind, count(DISTINCT event_id) AS exact, true AS close FROM events UNION ALL
  SELECT 'authors', count(DISTINCT user_id), true FROM events UNION ALL SELECT 'tabs', count(DISTINCT event_type), true FROM events""")
def r_heartbeat_sketched(spark, sf_dir):
    work = new_work_path(spark, "sketched")
    kinds = {"posts": F.col("event_id"), "authors": F.col("user_id"), "tabs": F.col("event_type")}

    def run(events):
        sketches = jobs.sketched_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", kinds, "1 day", "3 days")
        stateful.log_changes(sketches, f"{work}/log", f"{work}/checkpoint")

    in_batches(spark, sf_dir, work, run)
    about = jobs.sketched_totals(jobs.batch_log(spark, f"{work}/log", "start timestamp, kind string, sketch binary"))
    ids = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("id")) for k, v in kinds.items()])).alias("p")
    exact = table(spark, sf_dir, "events").select(ids).groupBy("p.kind").agg(F.count_distinct("p.id").alias("exact"))
    return exact.join(about, "kind", "left").select(
        "kind", "exact", F.coalesce(F.abs(F.col("total") - F.col("exact")) <= F.col("exact") * 0.02, F.lit(False)).alias("close"))


# Every 50th event is stamped a month back: later than the lateness allows, except in the first batch, where nothing came before.
LATE = "CASE WHEN event_id % 50 = 7 THEN CAST(ts AS TIMESTAMP) - INTERVAL 30 DAYS ELSE CAST(ts AS TIMESTAMP) END"


@query("r_late", """WITH top AS (SELECT max(event_id) // 3 + 1 AS size FROM events)
  SELECT CASE WHEN event_id % 50 = 7 AND event_id >= size THEN 'late' ELSE 'on time' END AS side, count(*) AS rows FROM events, top GROUP BY 1""")
def r_late(spark, sf_dir):
    work = new_work_path(spark, "late")
    def to(side):
        return lambda rows, number: rows.write.mode("overwrite").parquet(f"{work}/out/side={side}/batch={number}")

    in_batches(spark, sf_dir, work, lambda events: jobs.split_late(
        events.withColumn("ts", F.expr(LATE)), "ts", f"{work}/checkpoint", f"{work}/newest", to("on time"), to("late"), "3 days"))
    return spark.read.parquet(f"{work}/out").groupBy("side").agg(F.count(F.lit(1)).alias("rows"))


@query("a_authors", """SELECT CAST(count(DISTINCT (event_type, user_id)) AS BIGINT) AS authors FROM events""")
def a_authors(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_type", "user_id").agg(F.count_distinct(F.struct("event_type", "user_id")).alias("authors"))


@query("r_upsert", """SELECT user_id, event_type AS last_type, event_id AS last_id, f.first_id FROM events
  JOIN (SELECT user_id, max(event_id) AS m, min(event_id) AS first_id FROM events GROUP BY 1) f USING (user_id) WHERE event_id = m""")
def r_upsert(spark, sf_dir):
    work = new_work_path(spark, "upsert")

    def run(events):
        rows = events.select("user_id", F.col("event_type").alias("last_type"), F.col("event_id").alias("last_id"),
                             F.col("event_id").alias("first_id"))
        merged = stateful.merged_stream(rows, "user_id", {"last_type": "new", "last_id": "new", "first_id": "old"}, "last_id")
        stateful.log_changes(merged, f"{work}/log", f"{work}/checkpoint")

    in_batches(spark, sf_dir, work, run)
    return stateful.latest_rows(spark, f"{work}/log", "user_id")


@query("r_checkpoint", """WITH m AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'urn' || user_id ELSE 'u' || user_id END AS urn FROM events)
  SELECT urn, arg_max(event_type, event_id) AS last_type FROM m GROUP BY 1""")
def r_checkpoint(spark, sf_dir):
    work = new_work_path(spark, "flush")
    ids = table(spark, sf_dir, "events", "user_id").distinct().filter("user_id % 2 = 0").selectExpr("'u' || user_id AS handle", "'urn' || user_id AS member")

    def run(events):
        rows = events.selectExpr("'u' || user_id AS urn", "event_type AS last_type", "event_id AS seq")
        merged = stateful.merged_stream(rows, "urn", {"last_type": "new_else_old"}, "seq", ids, "handle", "member")
        stateful.log_changes(merged, f"{work}/log", f"{work}/checkpoint")

    in_batches(spark, sf_dir, work, run)
    return stateful.latest_rows(spark, f"{work}/log", "urn")


@query("r_breaker", f"{STREAK_SQL} SELECT event_id, session_id, streak, streak >= 2 AS deny_next FROM s")
def r_breaker(spark, sf_dir):
    work = new_work_path(spark, "breaker")

    def run(events):
        rows = events.selectExpr("event_id", "user_id AS session_id", "ts", "event_type IN ('error', 'signup') AS failed")
        decided = stateful.breaker_stream(rows, ["session_id"], "ts", "event_id", "failed")
        jobs.run_to_end(decided, f"{work}/out", f"{work}/checkpoint")

    in_batches(spark, sf_dir, work, run)
    return spark.read.parquet(f"{work}/out").select("event_id", "session_id", "streak", "deny_next")


PROFILE = ("'# CV\\n**Senior Web Lead | Data ' || c_custkey || '**\\n### **Staff Engineer (remote)**\\n- **Platforms & CMS:** Sanity, React, Cms' || c_custkey || '\\n- **Growth & Measurement:** HubSpot, A/B testing\\n"
           "- **Web Engineering:** GraphQL, Edge' || (c_custkey % 5) || '\\n- **Other:** nothing'")
TARGET_SQL = """WITH c AS (SELECT c_custkey AS k FROM customer), t AS (
    SELECT k, 'tier_b' AS tier, term FROM c, LATERAL (SELECT unnest(['senior web lead', 'web lead', 'data ' || k, 'staff engineer', 'engineer', 'sanity', 'cms' || k, 'hubspot']) AS term) u
    UNION ALL SELECT k, 'tier_c', term FROM c, LATERAL (SELECT unnest(['a/b testing', 'edge' || (k % 5), 'hiring']) AS term) u
    UNION ALL SELECT k, 'role_titles', term FROM c, LATERAL (SELECT unnest(['Senior Web Lead', 'Data ' || k, 'Staff Engineer']) AS term) u
    UNION ALL SELECT k, 'platform_terms', term FROM c, LATERAL (SELECT unnest(['sanity', 'cms' || k, 'hubspot']) AS term) u)"""


@query("a_targets", f"""{TARGET_SQL} SELECT k AS profile_id, tier, term FROM t WHERE NOT (tier = 'tier_c' AND k % 3 = 0)
  UNION ALL SELECT k, 'tier_c', 'override' || k FROM c WHERE k % 3 = 0""")
def a_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").selectExpr("c_custkey AS profile_id", f"{PROFILE} AS text")
    base = targets.tiered_terms(targets.profile_terms(docs, "profile_id"), "profile_id")
    override = table(spark, sf_dir, "customer").selectExpr("c_custkey AS profile_id", "'tier_c' AS tier", "'override' || c_custkey AS term", "0 AS pos").filter("profile_id % 3 = 0")
    return targets.with_override(base, override, "profile_id").select("profile_id", "tier", "term")


@query("a_target_companies", f"""{with_sql(STAGES)}, n AS (SELECT source, unnest(CASE WHEN row_id % 3 = 0 THEN [company_base, 'old ' || row_id] ELSE [company_base] END) AS term FROM stages WHERE state <> 'rejected')
  SELECT DISTINCT source AS profile_id, 'tier_a' AS tier, term FROM n UNION SELECT DISTINCT source, 'company_slugs', replace(term, ' ', '-') FROM n""")
def a_target_companies(spark, sf_dir):
    df = STAGES.spark(spark, sf_dir).withColumn("company", F.expr("company || CASE WHEN row_id % 3 = 0 THEN ' (formerly Old ' || row_id || ' Inc)' ELSE '' END"))
    return targets.company_terms(df, "source").select(F.col("source").alias("profile_id"), "tier", "term")
