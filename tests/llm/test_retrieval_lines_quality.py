"""Top-k retrieval, line dedup and the quality classifier against brute force and held-out labels."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmetric.llm import lines, quality, retrieval
from quillmetric.llm.boosting import Trees, fit
LONG = "All work and no play makes a dull corpus of words. " * 4000


def brute_top(rows, k):
    vectors = {}
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(1024 * x) for x in v]
        vectors[vec_id] = min(vectors.get(vec_id, q), q)
    out = []
    for query_id, q in vectors.items():
        if query_id % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), vec_id) for vec_id, v in vectors.items() if vec_id != query_id)
            out += [(query_id, n, vec_id, -s) for n, (s, vec_id) in enumerate(scored[:k], start=1)]
    return sorted(out)


def top(spark, rows, work, **sizes):
    docs = spark.createDataFrame([(i, v, "n", 1) for i, v in rows], "vec_id long, embedding array<double>, norm string, slice int")
    found = retrieval.top_k(docs, F.col("vec_id") % 100 == 0, work, **sizes)
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_top_k_is_exact(spark, work, kind):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=8)
    rows = []
    for i in range(420):
        v = centre + rng.normal(size=8) * 0.1 if kind == "clustered" and i % 3 else rng.normal(size=8)
        rows.append((i, (v * rng.uniform(0.1, 4)).tolist()))
    assert top(spark, rows, work, bucket_rows=32, query_rows=3) == brute_top(rows, 10)


def test_top_k_edges(spark, work):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, [2.0]), (8, []), (100, [-1.0, -1.0, 3.0]), (200, [0.0, 0.0]), (None, [9.0, 9.0]), (9, [-0.0001, 0.0])]
    rows += [(300 + i, [0.25, 0.25]) for i in range(1, 60)]
    assert top(spark, rows, work, bucket_rows=16) == brute_top(rows, 10)
    assert top(spark, [(100, [1.0])], work) == []
    assert top(spark, [], work) == []


def brute_lines(rows, sites=10, chars=16):
    """Lines of each (doc_id, text, source) that stay, by the plain rule."""
    where, first = defaultdict(set), {}
    for doc_id, text, source in rows:
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if len(line) >= chars:
                where[line].add(source or "")
                place = (doc_id is not None, doc_id or 0, n)
                first[line] = min(first.get(line, place), place)
    out = []
    for doc_id, text, source in rows:
        parts = (text or "").split("\n")
        stays = [len(where.get(s := p.strip(" \t\n\x0b\x0c\r"), ())) < sites or first[s] == (doc_id is not None, doc_id or 0, n)
                 for n, p in enumerate(parts)]
        kept = "\n".join(p for p, s in zip(parts, stays) if s)
        out.append((doc_id, text if all(stays) else kept, len(parts), len(parts) - sum(stays)))
    return sorted(out, key=str)


def cleaned(docs, work):
    got = lines.drop_boilerplate(docs, work)
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str)


def test_lines_near_the_threshold(spark, edges, no_docs, work):
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice([f"a line that many sites share {rng.randint(0, 40)} times", f"own line of document {i}",
                                       "  Home | About | Contact  ", "short", "", "12 is not enough for this"]) for _ in range(rng.randint(1, 9))),
             rng.choice([f"s{k}" for k in range(12)] + [None])) for i in range(300)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_removed long")
    assert cleaned(docs, work) == brute_lines(rows)
    assert lines.drop_boilerplate(docs, work).columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert cleaned(edges, work) == brute_lines([(r.doc_id, r.text, r.source) for r in edges.collect()])
    assert cleaned(no_docs, work) == []


def test_site_counts_agree_on_many_sites(spark, work):
    """Far above, near and far below the threshold."""
    docs = spark.createDataFrame([(s * 1000 + n, f"line number {n} is on some sites", f"site {s}") for n in range(40) for s in range(n * 5)],
                                 "doc_id long, text string, source string")
    keyed = lines._lines(lines._keyed(docs), 16)
    assert lines.spread_lines(keyed, work, min_sites=100).count() == sum(n * 5 >= 100 for n in range(40))


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = fit(x[:3000], y[:3000])
    assert ((trees.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97
    # traversal of one row by hand
    margin = trees.prior
    for f, c, v in zip(trees.feature, trees.cut, trees.value):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(x[0, f[node]] > c[node])
        margin += v[node - len(f)]
    assert math.isclose(margin, trees.margins(x[:1])[0])
    assert isinstance(fit(x[:0], y[:0]), Trees) and fit(x[:0], y[:0]).scores(x[:3]).tolist() == [0.5] * 3
    assert (fit(x[:50], np.ones(50)).scores(x[:3]) > 0.9).all()


def test_held_out_accuracy(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) >= 0.9 * len(bad)


def test_classifier_edges(spark, edges, no_docs, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (5, 7), (5, 0), (5, 1)], "doc_id long, quality int"))
    got = quality.classify(edges.unionByName(documents, allowMissingColumns=True), odd).collect()
    assert len(got) == edges.count() + documents.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) <= 2
    none = quality.classify(edges, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert quality.classify(no_docs, labels).count() == 0
    assert quality.accepted(edges, labels.limit(0)).columns == edges.columns
    assert np.isfinite(quality.statistics("")).all() and np.isfinite(quality.statistics(LONG)).all()
