"""The registered queries of the package: those with SQL against it, all with their contracts' leading columns."""

import duckdb
import pytest

from __spark_entry__ import queries
from quillmetric.llm import catalog

LEADING = {
    "op1_norm_bucket_top_k": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op2_line_site_spread": "doc_id:bigint text:string n_lines:bigint n_removed:bigint",
    "op3_quality_trees": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op4_secret_worklist": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op5_audio_features": "doc_id:bigint n_bytes:bigint payload_bytes:bigint payload_sha256:string tail_crc32:bigint media_bytes:bigint "
                          "media_sha256:string feature:string",
    "op6_simhash_ball": "doc_id:bigint fingerprint:string component_id:bigint",
    "op7_best_fit_packing": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op8_token_orc": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op9_chat_round_trip": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
    "op10_entropy_mix": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op11_page_text": "page_id:bigint url:string text:string n_chars:bigint",
    "op12_merkle_intervals": "doc_id:bigint leaf:string subroot:string root:string proof_sha256:string folded_root:string verified:boolean",
    "op13_audit_repair": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint cost:bigint audit:string "
                         "repaired_sha256:string",
}


def test_all_are_registered():
    assert set(catalog.QUERIES) == {*LEADING, "pipeline"} and set(catalog.QUERIES) <= set(queries())


@pytest.mark.parametrize("name", LEADING)
def test_columns(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    want = [tuple(c.split(":")) for c in LEADING[name].split()]
    assert df.dtypes[:len(want)] == want


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
