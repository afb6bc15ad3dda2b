"""Fingerprints and groups against brute force."""

import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmetric.llm import simhash
from quillmetric.llm.components import components


def brute_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "É", "c d", "\n", "\x1c"])).map(" ".join))
def test_fingerprint(text):
    assert simhash.majority_bits(simhash.shingle_hashes(text)) % 2 ** 64 == brute_print(text)


def test_hash_is_sparks(spark):
    text = "ein kleiner test"
    want = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert int(simhash.shingle_hashes(text)[0].view(np.int64)) == want


def brute_classes(rows):
    prints = [brute_print(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((d, p, least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def test_classes(documents, edges, no_docs, work):
    for docs in (documents, edges):
        got = simhash.classes(docs, work).collect()
        want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
        assert sorted(((r.doc_id, r.fingerprint % 2 ** 64, r.component_id) for r in got), key=str) == want
    assert simhash.classes(no_docs, work).count() == 0


def test_meeting_finds_all_pairs_within_two_bits(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()
    links = {(a, b) for a, b in edges}
    assert all(((a ^ b) % 2 ** 64).bit_count() <= 2 for a, b in links)

    def groups(pairs):
        root = {v: v for v in signed}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(v for v in signed if find(v) == r) for r in map(find, signed)}

    true = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2 ** 64).bit_count() <= 2]
    assert groups(links) == groups(true)


def test_components_of_a_path_and_a_hub(spark, work):
    path = [(i, i + 1) for i in range(100, 140)]
    hub = [(7, k) for k in range(1000, 1300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + hub + [(50, 50)], "a long, b long"), work).collect()}
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in range(1000, 1300)} == {7} and 50 not in got


def test_one_of_each(spark, edges, no_docs, work):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    near = list(words)
    near[200] = "changed"
    other = [f"v{rng.randint(0, 5000)}" for _ in range(400)]
    half = words[:200] + other[200:]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (4, " ".join(other)), (6, " ".join(half)), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.one_of_each(docs, work)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 8]
    left = simhash.one_of_each(edges, work)
    assert left.columns == edges.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 3, 5, 7, 8, 9, 10, None]))
    assert simhash.one_of_each(no_docs, work).count() == 0


def test_sketch_similarity():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2 ** 32, 90, dtype=np.uint32), rng.integers(0, 2 ** 32, 30, dtype=np.uint32)
    x, y = np.unique(np.concatenate([a, b])), np.unique(a)
    assert simhash.sketch_similarity(x, y) == len(y) / len(x)
    assert simhash.sketch_similarity(x[:0], y[:0]) == 1.0 and simhash.sketch_similarity(x, y[:0]) == 0.0


def test_same_words_in_many_orders(spark, work):
    """Texts of the same words share all fingerprints; near copies among them are found whatever lies between."""
    rng, texts = random.Random(11), []
    words = [f"w{k}" for k in range(60)]
    for _ in range(8):
        rng.shuffle(words)
        for first, last in ((0, 1), (1, 0)), ((0, 1), (0, 1)), ((1, 0), (1, 0)), ((1, 0), (0, 1)):
            texts.append(" ".join([words[first[0]], words[first[1]], *words[2:-2], words[-2 + last[0]], words[-2 + last[1]]]))
    rng.shuffle(texts)
    sets = [set(tuple(t.split()[i:i + 5]) for i in range(56)) for t in texts]
    want = {frozenset(j for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)) for x in sets}
    assert sorted(map(len, want)) == [4] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    groups = {}
    for r in simhash.near_classes(docs, work).collect():
        groups.setdefault(r.root, set()).add(r.least)
    assert set(map(frozenset, groups.values())) == want


def test_variants_are_never_broadcast(spark):
    """Few values stand for 65 times as many variants: the driver must not hold them, whatever Spark takes their size for."""
    rng = random.Random(23)
    base = [rng.getrandbits(62) for _ in range(40)]
    rows = [(2 * k + s, 2 * k + s, 100, [b ^ s, ~b], 0, b ^ s) for k, b in enumerate(base) for s in (0, 1)]
    members = spark.createDataFrame(rows, "node long, root long, shingles long, prints array<long>, view int, fingerprint long")
    pairs = simhash.pairs_apart(members)
    assert sorted(map(tuple, pairs.collect())) == [(2 * k, 2 * k + 1) for k in range(40)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[view#\d+, variant#", plan) and not re.search(r"BroadcastHashJoin \[view#\d+, variant#", plan)


def test_long_texts_at_the_limit(spark, work):
    """Sets of many shingles next to the limit are decided by the whole sets."""
    rng, rows, want = random.Random(17), [], set()
    for pair in range(24):
        words = [f"p{pair}w{k}" for k in range(1004)]
        other, step = list(words), 9
        alike = pair % 2 == 0
        # every lone change costs five shingles of a thousand on both sides: 22 leave 890 / 1110, 23 leave 885 / 1115
        for k in range(22 if alike else 23):
            other[20 + step * 4 * k % 980] = f"p{pair}x{k}"
        sets = [{tuple(t[i:i + 5]) for i in range(1000)} for t in (words, other)]
        assert (len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])) == alike
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
        want |= {2 * pair} if alike else {2 * pair, 2 * pair + 1}
    prints = {i: simhash.word_prints(t) for i, t in rows}
    met = [p for p in range(24) if any(((x ^ y) % 2 ** 64).bit_count() <= 2 for x, y in zip(prints[2 * p], prints[2 * p + 1]))]
    want |= {2 * p + 1 for p in range(24) if p not in met}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs, work).collect()} == want
    sketches = {i: simhash.shingle_sketch(t) for i, t in rows}
    assert all(simhash.sketch_verdict(sketches[2 * p], sketches[2 * p + 1]) is None for p in range(24))
    assert len(met) > 0
