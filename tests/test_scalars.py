"""Column functions on small fixtures."""

import random
import re

import plain_fuzz
from pyspark.sql import functions as F

from quillmetric.functions import dates, fuzz, numbers, people, text, urls
from quillmetric.operators import documents


def value(spark, raw, build, kind="string"):
    df = spark.createDataFrame([(raw,)], f"t {kind}")
    return df.select(build(F.col("t")).alias("v")).first()["v"]


def test_relevance_blend_and_neutral(spark):
    pillars = text.pillar_tokens("Design systems, web")
    assert pillars == ["design", "systems", "web"]
    assert value(spark, "A web of design systems!", lambda t: text.relevance(t, pillars)) == 1.0
    assert value(spark, "nothing here", lambda t: text.relevance(t, pillars)) == 0.0
    assert value(spark, "anything", lambda t: text.relevance(t, [])) == 0.5
    assert value(spark, "", lambda t: text.relevance(t, pillars)) == 0.0


def test_clip_prefers_sentence_then_word(spark):
    assert value(spark, "ab cd. ef gh ij", lambda t: text.clip_text(t, 10)) == "ab cd."
    assert value(spark, "abcdef ghijkl mnop", lambda t: text.clip_text(t, 10)) == "abcdef…"
    assert value(spark, "abcdefghijklmnop", lambda t: text.clip_text(t, 5)) == "abcde…"
    assert value(spark, None, text.clip_text) == ""


def test_scrubbers(spark):
    raw = "Mail jo.do@ex.co.uk or +49 (30) 1234-5678 — thanks"
    assert value(spark, raw, text.scrub_placeholders) == "Mail [email] or [number] - thanks"
    assert value(spark, raw, text.scrub_blank) == "Mail or — thanks"
    assert value(spark, "call 555-123-4567 now", text.scrub_placeholders) == "call [number] now"


def test_case_bound_keywords(spark):
    terms = ["Icon", "next.js", "ai agents"]
    build = lambda t: text.keyword_hits(t, terms, frozenset({"icon"}))
    assert value(spark, "an icon with Next.js", build) == ["next.js"]
    assert value(spark, "ICON ships AI agents", build) == ["Icon", "ai agents"]
    assert value(spark, "Icons and xnext.js", build) == []


def test_company_normalisers(spark):
    assert value(spark, "Pendo.io, Inc.", people.display_company) == "Pendo"
    assert value(spark, "The Acme Corp", people.display_company) == "Acme"
    assert value(spark, "Acme Software Labs, LLC", people.clean_company) == "acme"
    assert value(spark, "Labs", people.clean_company) == "labs"
    assert sorted(value(spark, "Foo AI / Bar Inc via Baz", people.org_aliases)) == ["bar", "baz", "foo", "foo bar via baz"]
    assert value(spark, None, people.org_aliases) in (None, [])


def test_roles_and_segments(spark):
    assert value(spark, "Sr SWE @ Acme", people.expand_roles) == "senior software engineer @ Acme"
    assert value(spark, "semi-pm pm2 PM", people.expand_roles) == "semi-product manager pm2 product manager"
    assert value(spark, "Lead at Acme | ex-Foo", people.segments) == ["Lead", "Acme", "ex", "Foo", "Lead at Acme | ex-Foo"]
    assert value(spark, "Former CTO at Foo", people.employer) is None
    assert value(spark, "CTO at Foo, Berlin", people.employer) == "Foo"


def test_mutual_connections(spark):
    got = value(spark, "Ann Lee and 3 other mutual connections", people.mutuals_proof)
    assert (got["count"], got["sample"]) == (4, ["Ann Lee"])
    got = value(spark, "Bo Chu is a mutual connection", people.mutuals_proof)
    assert (got["count"], got["sample"]) == (1, ["Bo Chu"])
    assert value(spark, "2nd; mutuals: Ann (x), Bo, +3 more", lambda t: people.mutual_names(t)) == ["Ann", "Bo"]


def test_numbers(spark):
    assert value(spark, "1.2M", numbers.compact_number) == 1_200_000
    assert value(spark, "45,231 followers", numbers.compact_number) == 45231
    assert value(spark, "n/a", numbers.compact_number) is None
    assert value(spark, "80–90 provisional; midpoint 85", numbers.score_text) == 85.0
    pay = value(spark, "$120K/yr - $150K/yr", numbers.salary_range)
    assert (pay["salary_min"], pay["salary_max"], pay["currency"], pay["interval"]) == (120000.0, 150000.0, "USD", "yearly")
    assert round(value(spark, "rgb(0, 0, 0)", lambda t: numbers.contrast(t, F.lit("rgb(255,255,255)"))), 6) == 21.0
    assert value(spark, "junk", numbers.count_or_zero) == 0


def test_dates(spark):
    assert str(value(spark, "Thu Jun 18 16:15:01 +0000 2026", dates.social_date)) == "2026-06-18"
    assert str(value(spark, "Connected on September 16, 2026", dates.connected_on)) == "2026-09-16"
    assert value(spark, "Connected 2 weeks ago", dates.connected_on) is None
    assert str(value(spark, "sent **Sept. 3, 2024**", dates.free_date)) == "2024-09-03"
    assert value(spark, "2024-02-31", dates.free_date) is None
    assert value(spark, "never", dates.unreadable_date) is False
    assert value(spark, "last week", dates.unreadable_date) is True
    assert value(spark, "500", dates.window_days) == 90
    assert value(spark, "x", dates.window_days) == 7
    assert value(spark, "-3", dates.window_days) == 1
    assert value(spark, "not-a-number", lambda t: dates.snowflake_age_hours(t, 0)) is None


def test_business_days_match_calendar(spark):
    import datetime as dt
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i),) for i in range(40)]
    today = dt.date(2024, 2, 5)
    df = spark.createDataFrame(rows, "d date")
    for row in df.select("d", dates.business_days_between(F.col("d"), today).alias("n")).collect():
        want = sum(1 for k in range(1, max((today - row["d"]).days, 1)) if (row["d"] + dt.timedelta(days=k)).weekday() < 5)
        assert row["n"] == want, row


def test_urls(spark):
    assert value(spark, "linkedin.com/in/Jo-Do/?x=1", urls.canonical_profile) == "https://www.linkedin.com/in/Jo-Do"
    assert value(spark, "jodo.example.org/in/x", urls.canonical_profile) is None
    assert value(spark, "https://de.linkedin.com/jobs/view/lead-77/", urls.job_id) == "77"
    assert value(spark, "https://www.linkedin.com/company/acme/about", urls.canonical_company) == "https://www.linkedin.com/company/acme/"
    assert value(spark, "https://www.linkedin.com/feed/update/urn:li:activity:99", urls.post_id) == "99"
    assert value(spark, "https://h/uas/login", lambda t: urls.block_reason(t, F.lit(""))) == "blocked page: /uas/login"


def _scored(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return [(r["a"], r["b"], r["s"]) for r in fuzz.with_similarity(df, "s", F.col("a"), F.col("b")).collect()]


def _word(rng, n, letters="abcd e"):
    text = "".join(rng.choice(letters) for _ in range(n))
    return "x" + text[1:-1] + "y" if n > 1 else "x"[:n]  # plain() leaves the length


def test_similarity_against_brute_force(spark):
    rng = random.Random(7)
    pairs = [(_word(rng, rng.randint(0, 40)), _word(rng, rng.randint(0, 50))) for _ in range(150)]
    pairs += [("ä ß ü", "ü ß x"), ("a a b", "b a"), ("...", "a"), ("A.B-c_d", "a b c d"), ("𝄞 é", "é 𝄞𝄞")]
    for a, b, score in _scored(spark, pairs):
        assert abs(score - plain_fuzz.pair_score(a, b)) < 1e-9
    assert _scored(spark, [(None, "a"), ("", ""), ("a", None)]) == [(None, "a", 0.0), ("", "", 0.0), ("a", None, 0.0)]


def test_similarity_at_word_borders(spark):
    """Lengths around one and several words of bits, on both sides."""
    rng = random.Random(21)
    sizes = [(61, 62), (62, 62), (62, 63), (63, 63), (63, 64), (64, 64), (64, 20), (20, 64), (124, 125), (125, 30), (256, 257), (257, 40), (40, 256)]
    pairs = [(_word(rng, n), _word(rng, m)) for n, m in sizes] + [(_word(rng, n, "a b"), _word(rng, m, "a b")) for n, m in sizes[:9]]
    pairs = [tuple(re.sub(" +", " ", x) if i % 2 else x for x in p) for i, p in enumerate(pairs)]
    for a, b, score in _scored(spark, pairs):
        assert abs(score - plain_fuzz.pair_score(a, b)) < 1e-9
    for target in (pairs[2][0], pairs[4][1], pairs[8][0], pairs[10][1]):
        df = spark.createDataFrame([([b for _, b in pairs[:9]],), ([pairs[0][0]],)], "c array<string>")
        for row in fuzz.with_best_similarity(df, "s", [target], F.col("c"), digits=9).collect():
            assert abs(row["s"] - max(plain_fuzz.pair_score(target, c) for c in row["c"])) < 1e-8


def test_similarity_is_planned_without_python(spark):
    df = spark.createDataFrame([(["Data lead"],)], "c array<string>")
    scored = fuzz.with_best_company_similarity(fuzz.with_best_similarity(df, "s", ["data"], F.col("c")), "t", "data", F.col("c")).filter("s > 1 AND t > 1")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and scored.count() == 1


def test_similarity_minima_and_guards(spark):
    scores = [s for _, _, s in _scored(spark, [("software engineer", "senior software engineer"), ("marketing manager", "marine biologist")])]
    assert scores[0] >= 80 and scores[1] < 60
    meta = spark.createDataFrame([(["metadata"],)], "c array<string>")
    assert fuzz.with_best_company_similarity(meta, "s", "meta", F.col("c")).first()["s"] < 70
    df = spark.createDataFrame([(["x", "stripe"],), (["strip club"],), (None,)], "c array<string>")
    got = [r["s"] for r in fuzz.with_best_company_similarity(df, "s", "stripe", F.col("c")).collect()]
    assert got[0] == 100.0 and 0 < got[1] < 100 and got[2] == 0.0


def test_best_similarity_is_the_maximum(spark):
    rng = random.Random(3)
    words = ["data", "lead", "engineer", "web", "growth", "senior", "chef"]
    rows = [([" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(5)],) for _ in range(50)]
    targets = ["data engineer", "growth lead"]
    df = spark.createDataFrame(rows, "c array<string>")
    for row in fuzz.with_best_similarity(df, "s", targets, F.col("c")).collect():
        assert row["s"] == round(max(plain_fuzz.pair_score(t, c) for t in targets for c in row["c"]), 2)


def test_part_similarity_takes_the_better_direction():
    assert abs(plain_fuzz.partial_ratio("abcd", "axbc") - 600 / 7) < 1e-9 and abs(plain_fuzz.partial_ratio("axbc", "abcd") - 600 / 7) < 1e-9


def test_company_similarity_against_brute_force(spark):
    rng = random.Random(13)
    words = ["acme", "ac", "acmecorp", "north star", "star", "metadata", "meta labs", "me ta"]
    rows = [([" ".join(rng.choices(words, k=rng.randint(1, 2))) for _ in range(3)],) for _ in range(60)] + [([],), ([""],)]
    df = spark.createDataFrame(rows, "c array<string>")
    for key in ("acme", "meta", "north star", "acmecor"):
        for row in fuzz.with_best_company_similarity(df, "s", key, F.col("c"), digits=9).collect():
            best = max((plain_fuzz.company_pair_score(key, c) for c in row["c"]), default=0.0)
            assert abs(row["s"] - best) < 1e-8


def test_counts_days_and_hidden_text(spark):
    texts = ["12.0", "1234567890123456789", "99999999999999999999", " -7 ", "1.9", "x", "", None, "+5", "1e3", "9999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(numbers.count_or_zero(F.col("t")), dates.window_days(F.col("t"))).collect()]
    assert [g[0] for g in got] == [12, 1234567890123456789, 0, -7, 1, 0, 0, 0, 5, 0, 9999999999]
    assert [g[1] for g in got] == [7, 90, 90, 1, 7, 7, 7, 7, 5, 7, 90]
    docs = ["a\n```py\nx <!-- y\n```\nb <!-- c\n``` -->d", "\ue000 kept", "~~~\nopen to the end", "``\nshort", "````\n```\nin\n````\nout", "<!-- x"]
    seen = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "t string").select(documents.visible(F.col("t"))).collect()]
    assert seen == ["a\n\n\n\nb \nd", "\ue000 kept", "\n", "``\nshort", "\n\n\n\nout", ""]
