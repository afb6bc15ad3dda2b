"""Page text, Merkle manifest and conversation repair against plain versions."""

import hashlib
import heapq
import html
import itertools
import os
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DOCS, EDGES, row
from quillmetric.llm import merkle, page_text, repair


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    ways, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, above_owners = [], []
        for s in range(0, len(nodes), 8):
            run = nodes[s:s + 8]
            for k in range(len(run)):
                for i in owners[s + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(H(*run))
            above_owners.append(sum(owners[s:s + 8], []))
        nodes, owners = above, above_owners
    return nodes[0], ways


def plain_manifest(rows):
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        lower = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        fields = (doc_id, source, lang, n_chars)
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        by.setdefault(lang, []).append((doc_id, leaf(*fields, text), leaf(*fields, lower if changed else text)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = plain_tree([r[1] for r in by[lang]])
    root, top_ways = plain_tree([trees[x][0] for x in langs]) if langs else (None, [])
    out = []
    for lang, above in zip(langs, top_ways):
        for (doc_id, own, node), way in zip(by[lang], trees[lang][1]):
            way = way + above
            for before, after in way:
                node = H(before, node, after)
            out.append((doc_id, own, trees[lang][0], root, H(*itertools.chain(*way)), node, node == root))
    return out


def fields(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def in_lang(doc, lang):
    return (*doc[:2], lang, *doc[3:])


@pytest.mark.parametrize("docs", [
    [], [row(1, "Lone")], EDGES, [in_lang(d, lang) for d in EDGES for lang in (None, "", "é", "en")],
    [in_lang(row(i, f"Text {i // 3}"), f"l{i % 11}") for i in range(300)] + [row(i, "Same") for i in range(600)],
])
def test_manifest(spark, work, docs):
    df = spark.createDataFrame(docs, DOCS)
    assert sorted(map(repr, map(tuple, merkle.manifest(df, work).collect()))) == sorted(map(repr, plain_manifest(fields(df))))


def test_manifest_levels_on_documents(spark, work, documents):
    got = merkle.manifest(documents, work)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_manifest(fields(documents)))


def test_manifest_intervals(spark, work, documents):
    digests = documents.selectExpr("doc_id", "lang AS grp", "sha2(text, 256) AS hash")
    levels = merkle.climb(merkle.leaves_of(digests, ["doc_id"], work), work)
    for nodes in levels[1:]:
        for node in nodes.collect():
            spans = [(c["lo"], c["hi"]) for c in node["children"]]
            assert (spans[0][0], spans[-1][1]) == (node["lo"], node["hi"]) and len(spans) <= 8
            assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


# conversations

ROLES = {"s": "system", "u": "user", "a": "assistant", "x": "xena", "": ""}


def plain_repair(rows):
    """Cheapest edits of rows ``(role, text, fault)``, least string first: cost, audit and repaired turns."""
    state_after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap = [(0, "", "", 0, [])]
    seen = set()
    while heap:
        cost, audit, state, at, turns = heapq.heappop(heap)
        if (state, at) in seen:
            continue
        seen.add((state, at))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, turns
        wanted = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", wanted[0], at, turns + [(wanted, "")]))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", state, at + 1, turns))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (state, role[:1]) in state_after:
                    heapq.heappush(heap, (cost + more, audit + "K", state_after[state, role[:1]], at + 1, turns + [(role, text)]))
                heapq.heappush(heap, (cost + 1 + more, audit + "R", wanted[0], at + 1, turns + [(wanted, text)]))


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def audit_of(rows):
    one = repair._Conversation(1)
    turns = []
    for turn, (role, text) in enumerate(rows):
        earlier = [i for i, r in enumerate(rows[:turn]) if r == (role, text)]
        if earlier:
            one.repeated(turn, role, hashlib.sha256(text.encode()).digest())
        turns.extend(one.add(turn, role, text))
    turns.extend(one.end())
    return [(t[2], t[3]) for t in turns[:-1]], turns[-1]


TURNS = st.lists(st.tuples(st.sampled_from(list(ROLES.values())), st.sampled_from(["a.", "b!", "c", " ", "d?\n", "e. "])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_audits_are_the_cheapest_and_least(rows):
    turns, last = audit_of(rows)
    cost, audit, want = plain_repair(plain_faults(rows))
    assert (last[9], last[10], turns) == (cost, audit, want)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns))
    assert last[11] == H("\n".join(f"{r}:{t}" for r, t in turns))


@pytest.mark.parametrize("modulus", [1, 2, (1 << 61) - 1])
def test_collisions_change_nothing(modulus):
    """With a modulus of 1 all hashes collide: every decision rests on verified prefixes."""
    rng, tree = random.Random(3), repair.Prefixes(modulus=modulus)
    nodes = [0]
    for _ in range(400):
        nodes.append(tree.add(rng.choice(nodes[-12:]), rng.choice("DIKR")))
    for x, y in itertools.product(nodes[::7], nodes[::11]):
        assert tree.less(x, y) == (tree.string(x) < tree.string(y))
    assert tree.string(tree.shared(nodes[-3:])) == os.path.commonprefix([tree.string(n) for n in nodes[-3:]])


def test_settled_edits_are_forgotten(monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice(["user", "assistant", "system"]), rng.choice([f"a{i}.", f"b{i}", f" {i}!", "  "])) for i in range(3000)]
    turns, last = audit_of(rows)
    monkeypatch.setattr(repair, "SETTLE_NODES", 10 ** 9)
    assert (turns, last) == audit_of(rows)
    monkeypatch.setattr(repair, "SETTLE_NODES", 64)
    one, most = repair._Conversation(1), 0
    for turn, (role, text) in enumerate(rows):
        list(one.add(turn, role, text))
        most = max(most, len(one.open), len(one.repair.prefixes) // 10)
    assert most < 100
    assert list(one.end())[-1][10] == last[10]


CONVERSATIONS = "conv_id long, turn long, role string, text string, kind string, digest int"


def plain_query(rows):
    """The contract of the query, one conversation after another."""
    by = {}
    for conv_id, turn, role, text, *_ in rows:
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        kept = by.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept.extend([(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1))
    out = []
    for conv_id, kept in by.items():
        kept.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        judged = plain_faults([r[2:] for r in kept])
        faults = [f for *_, f in judged]
        cost, audit, turns = plain_repair(judged)
        numbers = {r[1] for r in kept if r[0]}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out.append((conv_id, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    H("\n".join(f"{r}:{t}" for r, t in turns))))
    return out


def test_repair_query(spark, work):
    rng = random.Random(11)
    rows = [(c, t, rng.choice([None, "user", "user", "assistant", "assistant", "system", "", "other"]),
             rng.choice([None, "", "Yes.", "Yes.", "No", f"Turn {t}?", "é\n…", "Very " * 500 + "long."]), "k", 1)
            for c in [None, *range(60)] for t in [None, *range(rng.randint(0, 9))]]
    rows += rows[:40] + [(7, t * 3, "user", "Same again.", "k", 1) for t in range(30)]
    got = repair.audits(repair.repaired(repair.damaged(spark.createDataFrame(rows, CONVERSATIONS)), work))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_query(rows)))


def test_repaired_turns_are_stored(spark, work):
    rows = [(1, 0, "user", "Hi.", "k", 1), (1, 1, "user", "Hello?", "k", 1), (2, 5, "assistant", " ", "k", 1)]
    df = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("conv_id", "turn", "role", "text", "false AS dropped")
    found = repair.repaired(df, work)
    turns = [tuple(r) for r in found.filter("position IS NOT NULL").select("conv_id", "position", "role", "text").orderBy("conv_id", "position").collect()]
    assert turns == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello?")]
    assert [tuple(r)[:2] + (r.audit,) for r in repair.audits(found).orderBy("conv_id").collect()] == [(1, 0, "KR"), (2, 0, "D")]


def test_repair_of_nothing(spark, work):
    assert repair.audits(repair.repaired(repair.damaged(spark.createDataFrame([], CONVERSATIONS)), work)).collect() == []


# pages

def plain_page(page):
    body = re.search("<article>(.*)</article>", page, re.S).group(1)
    blocks = [html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))) for b in re.split("</?(?:p|h1)>", body)]
    return "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def test_pages_of_the_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in page_text.extract_pages(pages).collect()}
    assert got == {r.page_id: plain_page(r.html) for r in pages.collect()}


SENTENCE = "A sentence of the article that is long enough to look like one, with several words."
AROUND = """<html><head><title>No</title><style>no</style></head><body class="has-sidebar"><header><h1>No</h1></header>
<div class="cookie-notice">No: {s}</div><nav><ul><li><a href="/">No</a></ul></nav>{main}
<section id="comments"><h2>No</h2><p>No: {s}</p></section><aside><p>No: {s}</p></aside><form><label>No</label></form>
<footer><p>No: {s}</p></footer><script>var no = "<p>no</p>";</script></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div role=main>{}</div>", "<div class='post'><div>{}</div></div>",
                                  "<article><header>{}</header><aside>No</aside><p hidden>No</article>"])
def test_only_the_article(wrap):
    inner = f"<h1>Title &amp; more</h1><p>{SENTENCE}<p>Short.<div class='ad'>No</div><ul><li>One<li>Two&nbsp; <b>x</b>y</ul><p>{SENTENCE}<br>End</p>"
    want = f"Title & more\n{SENTENCE}\nShort.\nOne\nTwo xy\n{SENTENCE} End"
    assert page_text.main_text(AROUND.format(s=SENTENCE * 3, main=wrap.format(inner))) == want


def test_short_articles_win_over_long_boxes():
    page = f"<body><article><h1>Be</h1><p>Be<article class=comment>No {SENTENCE}</article></article><div>{SENTENCE * 9}</div>"
    assert page_text.main_text(page) == "Be\nBe"


def test_unmarked_menus_are_left_out():
    links = "".join(f"<li><a href=/{i}>Some other page number {i}</a>" for i in range(20))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Title</h1></div><div><p>{SENTENCE}<p><a href=/x>Linked</a> text: {SENTENCE}</div><div><ul>{links}</ul></div>"
    assert page_text.main_text(page) == f"Title\n{SENTENCE}\nLinked text: {SENTENCE}"


def test_broken_and_empty_pages(spark):
    cases = {None: "", "": "", "<nav>No": "", "plain &lt; text": "plain < text", "<p>one<p>two</div>": "one\ntwo", "<article><p>a<!-- no --> b": "a b",
             "<head><title>No</title><article>yes</article>": "yes", "<p>" + "word " * 400000: "word " * 399999 + "word", "</p></b></article>": "",
             "<article><p>bad &amp entity &#x1F388; &nosuch; \0": "bad & entity 🎈 &nosuch; \0"}
    rows = [(i, None if i == 3 else f"u{i}", page, "extra", 5) for i, page in enumerate(cases)] * 2 + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = page_text.extract_pages(df).collect()
    assert len(got) == len(rows)
    want = dict(enumerate(cases.values()))
    assert all(r.text == want.get(r.page_id, "") and r.n_chars == len(r.text) for r in got)


def test_long_pages_in_pieces():
    blocks = [f"Paragraph {i}: {SENTENCE}" for i in range(20000)]
    assert page_text.main_text("<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>") == "\n".join(blocks)


def test_smoothing():
    assert page_text.smoothed([4.0] * 9) == pytest.approx([4.0] * 9)
    peak = page_text.smoothed([0.0] * 10 + [1.0] + [0.0] * 10)
    assert peak[10] == max(peak) and peak[9] == pytest.approx(peak[11]) and sum(peak) == pytest.approx(1)
