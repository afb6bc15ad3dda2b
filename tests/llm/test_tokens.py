"""Token ids, packing and ORC files against the tokenizer itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmetric.llm import packing, token_orc
from quillmetric.llm.tokens import Encoder, encoder, vocabulary_path

ODD = " \n\t\r\x0b\x1c\x85\xa0 'sdll.,!12½Ⅷab éЖ中🎈\\<|endoftext|>"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list(ODD) + ["word", " the", "it's", "   ", "\n\n", "<|endoftext|>"])).map("".join))
def test_shared_chunks_give_the_tokenizers_ids(text):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    assert np.frombuffer(encoder(vocabulary_path()).encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_the_librarys():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a <|endoftext|", "<|endoftext|><|endoftext|> a  b"):
        assert np.frombuffer(encoder(vocabulary_path()).encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(vocabulary_path()).encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


def test_plain_characters_are_split_as_by_the_library(plain):
    for code in [0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0xA1, 0x0250)]:
        c = chr(code)
        for text in (f"a {c}b a{c} {c}{c}1{c}\nx{c} {c}'s", f"é!{c} é{c}!\n{c}É a.\nb{c}{c} 2{c}"):
            assert np.frombuffer(encoder(vocabulary_path()).encode(text), "<u4").tolist() == plain(text)


def test_the_model_meets_a_word_once_whatever_marks_follow(plain):
    class Counting:
        def __init__(self, model):
            self.model, self.met = model, Counter()

        def tokenize(self, letters):
            self.met[letters] += 1
            return self.model.tokenize(letters)

    shared = Encoder(vocabulary_path())
    shared.model = counting = Counting(shared.model)
    text = "Ein Haus Haus. Haus!! Haus.\nHaus Haus$$$ (Haus) Haus.\nHaus, Haus!!"
    assert np.frombuffer(shared.encode(text), "<u4").tolist() == plain(text)
    assert set(counting.met.values()) == {1}


def test_documents_give_the_tokenizers_ids(documents, plain):
    for text, in documents.select("text").limit(150).collect():
        assert np.frombuffer(encoder(vocabulary_path()).encode(text), "<u4").tolist() == plain(text)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def expected_index(rows, plain):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text or "") + [0]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_orc_round_trip(spark, documents, work, plain):
    path = work.new("tokens")
    token_orc.write_tokens(documents.repartition(5), path)
    got = [tuple(r) for r in token_orc.token_index(spark, path, work).orderBy("doc_id").collect()]
    assert got == expected_index([(r.doc_id, r.text) for r in documents.collect()], plain)
    wanted = token_orc.read_tokens(spark, path, [3, 17])
    assert {r.doc_id for r in wanted.collect()} == {3, 17}
    assert "PushedFilters: [In(doc_id, [" in wanted._jdf.queryExecution().toString()


def test_orc_edges(spark, edges, no_docs, work, plain):
    path = work.new("tokens")
    token_orc.write_tokens(edges, path)
    got = token_orc.token_index(spark, path, work).collect()
    want = expected_index([(r.doc_id, r.text) for r in edges.collect()], plain)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((a, c, d) for a, _, c, d in want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    empty = work.new("tokens")
    token_orc.write_tokens(no_docs, empty)
    assert token_orc.token_index(spark, empty, work).count() == 0


def check_packing(rows, texts, plain, capacity):
    """Every piece of every document once, sequences without gaps."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for doc_id, text in texts:
        ids = plain(text or "") + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, crc(ids[a:b])] += 1
    assert Counter({k: len(v) for k, v in pieces.items()}) == want
    for placed in places.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places), sum(k[3] * n for k, n in want.items())


def test_packing(documents, edges, no_docs, work, plain):
    for docs in (documents, edges):
        rows = packing.pack_documents(docs, work).collect()
        used, tokens = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], plain, packing.CAPACITY)
        assert used <= -(-tokens // packing.CAPACITY) * 1.1 + 1
    assert packing.pack_documents(no_docs, work).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=41)
    used = Counter()
    for pattern, times in packing.plan_patterns(counts, 40):
        assert sum(pattern) <= 40 and times > 0
        used.update({n: pattern.count(n) * times for n in set(pattern)})
    assert used == Counter(lengths)


def test_exact_complements_fill_sequences():
    counts = np.zeros(1025, dtype=np.int64)
    counts[[700, 324, 500, 300, 224, 600, 210, 130, 84]] = [5, 5, 2, 2, 2, 1, 1, 1, 1]
    plan = packing.plan_patterns(counts)
    assert all(sum(p) == 1024 for p, _ in plan)
    assert sorted(len(p) for p, _ in plan) == [2, 3, 4]
