"""The queries of this package, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillmetric.llm import (audio, chat, lines, merkle, mixing, packing, page_text, quality, repair, retrieval, secret_scan, simhash,
                             structure_sql, token_orc)
from quillmetric.llm.work import Workspace

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


TOP_K_SQL = """
WITH vectors AS (
  SELECT vec_id, min([floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]), false)
  GROUP BY vec_id),
products AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM products)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op1_norm_bucket_top_k", TOP_K_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return retrieval.top_k(embeddings, F.col("vec_id") % 100 == 0, Workspace(spark))


# A line's first place is the least (doc_id, line number); documents without an id do not occur in the checked tables.
LINE_SPREAD_SQL = r"""
WITH split AS (SELECT doc_id, text, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
placed AS (SELECT doc_id, site, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM split),
long_lines AS (
  SELECT doc_id, site, line_no, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM placed),
judged AS (SELECT * FROM long_lines WHERE length(line) >= 16),
spread AS (SELECT line, min({'doc_id': doc_id, 'line_no': line_no}) AS first_place FROM judged GROUP BY line HAVING count(DISTINCT site) >= 10),
gone AS (
  SELECT DISTINCT j.doc_id, j.line_no FROM judged j JOIN spread s USING (line)
  WHERE NOT (j.doc_id = s.first_place.doc_id AND j.line_no = s.first_place.line_no)),
kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.line_no) FILTER (WHERE g.line_no IS NULL) AS text,
         count(*) AS n_lines, count(g.line_no) AS n_removed
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.line_no = g.line_no GROUP BY p.doc_id)
SELECT k.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed
FROM kept k JOIN split s USING (doc_id)
"""


@query("op2_line_site_spread", LINE_SPREAD_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return lines.drop_boilerplate(docs, Workspace(spark)).select("doc_id", "text", "n_lines", "n_removed")


@query("op3_quality_trees")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents", "doc_id", "text"),
                            table(spark, sf_dir, "labels", "doc_id", "quality"))


@query("op4_secret_worklist")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op5_audio_features")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    media, features = work.new("media"), work.new("features")
    audio.store_media(table(spark, sf_dir, "documents", "doc_id", "text"), media)
    audio.store_features(spark, media, features)
    return audio.feature_rows(spark, features)


@query("op6_simhash_ball")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents", "doc_id", "text"), Workspace(spark))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), Workspace(spark))


@query("op8_token_orc")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    path = work.new("tokens")
    token_orc.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return token_orc.token_index(spark, path, work)


# Escaping adds one character per control string, or per control string and backslash where backslashes could be misread.
CHAT_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, len(regexp_extract_all(text, '\[INST\]|\[/INST\]|<s>|</s>|\[ROLE:|\[/ROLE\]')) AS controls,
         length(text) - length(replace(text, chr(92), '')) AS slashes,
         contains(text, chr(92) || chr(92)) OR regexp_matches(text, '\\(\[INST\]|\[/INST\]|<s>|</s>|\[ROLE:|\[/ROLE\])')
           OR (role = 'assistant' AND suffix(text, chr(92))) AS doubtful
  FROM rows_),
sized AS (
  SELECT *, length(text) + controls + CASE WHEN doubtful THEN slashes ELSE 0 END
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 16 + length(role) END AS chars
  FROM marked)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op9_chat_round_trip", CHAT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return chat.format_conversations(conversations, Workspace(spark))


@query("op10_entropy_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"), Workspace(spark))


@query("op11_page_text", structure_sql.PAGE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op12_merkle_intervals", structure_sql.MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents", *merkle.FIELDS), Workspace(spark))


@query("op13_audit_repair", structure_sql.REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair.audits(repair.repaired(repair.damaged(conversations), Workspace(spark)))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
