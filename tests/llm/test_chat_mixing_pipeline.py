"""Chat round trips, the mix of sources and the pipeline against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quillmetric.llm import chat, lines, mixing, quality
from conftest import EDGES

PARTS = [*chat.CONTROLS, "\\", " ", "]", "[", "/", "text", "\n", "é", "</", "s>", "[ROLE", " [/INST]", "</s>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b\\", "x] y", "\n"]),
                          st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), max_size=4))
def test_conversations_round_trip(turns):
    formatted = "".join(chat.render_identical(role, text)[0] for role, text in turns)
    parsed = chat.parse(formatted)
    assert [(r, t) for r, t, _, _ in parsed] == turns
    assert all(chat.unescape(formatted[a:b]) == t for _, t, a, b in parsed)


def test_plain_texts_are_not_escaped():
    assert chat.render_identical("user", "a \\n b [x] <b>")[0] == "[INST] a \\n b [x] <b> [/INST]"
    assert chat.render_identical("assistant", "see [INST]")[0] == " see \\[INST]</s>"


def brute_chat(rows):
    by = defaultdict(list)
    for conv_id, turn, role, text in rows:
        by[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv_id, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.add((conv_id, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss),
                 hashlib.sha256(loss.encode()).hexdigest()))
    return out


SAMPLE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_chat_rows(spark, sf_dir, work):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = [(None, 0, "user", "x"), (None, None, None, None), (5000, 2, "assistant", ""), (5000, 1, "system", "<s>"), (5000, 2, "assistant", ""),
           (5001, 1, "tool", "long " * 50000), (5002, 3, "assistant", "\\</s>\\")]
    more = conversations.select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")).selectExpr("*", "'x' AS segment", "1 AS n_turns")
    got = chat.format_conversations(more, work).collect()
    want = brute_chat([(r.conv_id, r.turn, r.role, r.text) for r in more.collect()] + SAMPLE)
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)
    empty = chat.format_conversations(more.limit(0), work).collect()
    assert [r.conv_id for r in empty] == [-1] and empty[0].loss_chars == 21


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(docs, work):
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    got = mixing.mix(docs, work).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, n) for i, _, n in rows)
    total = Counter()
    for _, source, n in rows:
        total[source] += n
    target = brute_targets(total)
    assert all(r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] if r["size"] else r.taken == 0 for r in got)
    source_of, ids = {}, Counter(i for i, _, _ in rows)
    source_of = {i: s for i, s, _ in rows if ids[i] == 1}
    taken = Counter()
    for r in got:
        if r.doc_id in source_of:
            s = source_of[r.doc_id]
            assert r.source_size == total[s] and r.target == pytest.approx(target[s])
            taken[s] += r.taken
    return got, taken, target


def test_mix_of_documents(spark, documents, work):
    got, taken, target = check_mix(documents, work)
    source_of = {r.doc_id: r.source for r in documents.collect()}
    for r in got:  # no copy more or less of any document would bring its source nearer
        miss = round(target[source_of[r.doc_id]]) - taken[source_of[r.doc_id]]
        possible = r.taken < 3 * r["size"] if miss > 0 else r.taken > 0
        assert not possible or abs(abs(miss) - r["size"]) >= abs(miss)
    assert sum(abs(taken[s] - target[s]) for s in target) <= 0.01 * sum(target.values())
    again = mixing.mix(documents.repartition(7), work).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.repeat_documents(documents, work).count() == sum(r.taken // r["size"] for r in got if r["size"])


def test_mix_with_hot_cells_and_caps(spark, work):
    rows = [(i, "w " * (1 + i % 3), "hot") for i in range(6000)] + [(10_000 + i, "a b c d", s) for i, s in enumerate(["tiny", None, "", "z"])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n long, target string")
    _, taken, target = check_mix(docs, work)
    assert all(abs(taken[s] - target[s]) <= max(0.001 * target[s], 4) for s in target)
    assert taken["z"] == 12


def test_mix_edges(edges, no_docs, work):
    check_mix(edges, work)
    assert mixing.mix(no_docs, work).count() == 0 and mixing.repeat_documents(no_docs, work).count() == 0
    assert mixing.repeat_documents(edges, work).columns == edges.columns


def test_slopes_reach_targets(documents, work):
    sized, _ = mixing.mix_plan(documents, work)
    cells = work.table(sized.groupBy("src", "no_src", "size").count().withColumnRenamed("count", "n"), "cells")
    solved = mixing.slopes(cells, mixing.source_targets(cells, work), work)
    assert all(r.saturated or abs(r.slope) < 50 for r in solved.collect())
    import math
    reached = Counter()
    state = {r.src: r for r in solved.collect()}
    for r in cells.collect():
        s = state[r.src]
        reached[r.src] += r.n * r["size"] * (3 if s.saturated else min(3, math.exp(s.slope * r["size"] / s.scale)))
    assert all(reached[k] == pytest.approx(s.target, rel=1e-5) for k, s in state.items())


def test_pipeline(spark, documents, sf_dir, work):
    docs = documents.unionByName(spark.createDataFrame(EDGES[:9], "doc_id long, text string, lang string, source string, n_chars long, a long, b string, c int, d string, e long, f int, g string").select("doc_id", "text", "lang", "source", "n_chars"))
    start = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = work.table(stage(spark, docs, sf_dir), "stage")
        assert out.columns == docs.columns, name
        if name == "quality classifier":
            scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
            assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in scored if r.predicted)
        if name == "line dedup":
            want = lines.drop_boilerplate(docs, work).select("doc_id", "text").collect()
            assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(map(tuple, want))
        if name == "SimHash near-dedup":
            texts = [r.text or "" for r in out.collect()]
            assert len(set(texts)) == len(texts)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in docs.collect())
    for empty in (start.limit(0),):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, empty, sf_dir).count() == 0


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 1024


def test_copies_of_a_hot_cell_are_the_plan(spark, work):
    """All documents of a cell have one size, so the border of the extra copies falls among many of a bucket."""
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("three words here").alias("text"),
                                       F.when(F.col("id") % 5 < 3, "a").otherwise("b").alias("source"))
    sized, plan = mixing.mix_plan(docs, work)
    got = {r.src: (r.taken, r.copies) for r in sized.join(plan, ["src", "no_src", "size"]).groupBy("src").agg(
        F.sum(mixing.taken_copies()).alias("taken"), F.first("copies").alias("copies")).collect()}
    assert len(got) == 2 and all(taken == copies for taken, copies in got.values()) and any(copies % 20_000 for _, copies in got.values())


def test_pipeline_stages_hand_few_texts_to_python_at_a_time(spark, edges, sf_dir):
    import pyarrow as pa

    import corpus_pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for stage in (corpus_pipeline.near_copy_stage, corpus_pipeline.packing_stage):
            spark.conf.set(name, "10000")
            stage(spark, edges, sf_dir)
            got = [r["n"] for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()]
            assert sum(got) == 5000 and max(got) <= 1000
        spark.conf.set(name, "7")
        corpus_pipeline.packing_stage(spark, edges, sf_dir)
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)
