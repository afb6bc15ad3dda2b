"""Text column functions: tokens, relevance, clipping, scrubbing, markup, slugs, keyword hits."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words ignored when a post is compared with content pillars.
STOP_WORDS = (
    "the", "a", "an", "to", "for", "how", "is", "in", "of", "on",
    "and", "with", "from", "by", "at", "this", "that", "it", "my",
    "your", "i", "me", "we", "you", "what", "are", "do", "can",
    "its", "be", "or", "not", "no", "so", "if", "but", "about",
    "all", "just", "get", "has", "have", "was", "will",
)

# Every line terminator text files are split on.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Generic company names that only count in Title or UPPER case.
CASE_BOUND_NAMES = frozenset({"icon", "employ", "typeface", "snowflake", "samba", "aquent"})

# Contact-data patterns of the two scrubbers.
EMAIL_ANY = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
NUMBER_ANY = r"(?<!\d)(?:\+\d[\d\-. ()]{8,}\d|\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4})(?!\d)"
EMAIL_STRICT = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
NUMBER_STRICT = r"(?U)(?<![\w/])\+?\d[\d\s().-]{8,}\d(?![\w/])"

RELEVANCE_COVERAGE, RELEVANCE_PRECISION, PRECISION_SLACK = 0.65, 0.35, 4
CLIP_LIMIT = 280

# What (?U)\s matches.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"

# Slice length that takes everything up to the end of an array.
ALL_REST = 1 << 30


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it many times, above all inside array functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns behind a generator, so that later filters and expressions read them instead of repeating them."""
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(packed))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(text, F.lit(WHITE_SPACE))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK, -1)


def literal_array(values: Sequence[str]) -> Column:
    """Parameter list as a constant array column."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Distinct lower-case words without stop words and one-character tokens."""
    words = F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(kept)


def pillar_tokens(pillars: str | None) -> list[str]:
    """Token set of a comma-separated pillar parameter, by the same rule as the tokens of a text."""
    from quillmetric.functions.constants import constant
    return list(constant(tokens(F.lit((pillars or "").replace(",", " ")))))


def relevance_raw(text: Column, pillars: Sequence[str]) -> Column:
    """Unrounded blend of pillar coverage and precision, 0 to 1."""
    if not pillars:
        return F.lit(0.5)
    words = tokens(text)
    shared = F.size(F.array_intersect(words, literal_array(pillars))).cast("double")
    coverage = shared / F.lit(float(len(pillars)))
    precision = shared / F.least(F.size(words), F.lit(len(pillars) + PRECISION_SLACK)).cast("double")
    blend = F.lit(RELEVANCE_COVERAGE) * coverage + F.lit(RELEVANCE_PRECISION) * precision
    return F.when(shared > 0, F.least(F.lit(1.0), blend)).otherwise(F.lit(0.0))


def relevance(text: Column, pillars: Sequence[str]) -> Column:
    return F.bround(relevance_raw(text, pillars), 2)


def clip_text(text: Column, limit: int = CLIP_LIMIT) -> Column:
    """Cut at the last sentence end in the second half of the limit, else at the last word."""
    flat = squeeze(F.coalesce(text, F.lit("")))
    window = F.substring(flat, 1, limit + 1)
    sentence = F.regexp_extract(window, r"(?s)^(.*[.!?]) ", 1)
    word = F.regexp_extract(window, r"(?s)^(.*) ", 1)
    # the reported position is that of the end mark, so a sentence of n characters cuts at n - 1
    return (
        F.when(F.length(flat) <= limit, flat)
        .when(F.length(sentence) - 1 >= limit * 0.5, strip(sentence))
        .when(F.length(word) > 0, F.concat(F.regexp_replace(word, r"\s+$", ""), F.lit("…")))
        .otherwise(F.concat(F.substring(flat, 1, limit), F.lit("…")))
    )


def scrub_placeholders(text: Column) -> Column:
    """Replace e-mails and phone numbers by placeholders and long dashes by hyphens."""
    out = F.regexp_replace(text, EMAIL_ANY, "[email]")
    out = F.regexp_replace(out, NUMBER_ANY, "[number]")
    return F.translate(out, "—–", "--")


def scrub_blank(text: Column) -> Column:
    """Remove e-mails and phone numbers and squeeze the gaps they leave."""
    out = F.regexp_replace(F.regexp_replace(text, EMAIL_STRICT, ""), NUMBER_STRICT, "")
    return strip(F.regexp_replace(out, r"(?U)\s{2,}", " "))


def strip_markup(text: Column) -> Column:
    """Keep link labels; drop bold marks and back ticks."""
    out = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return strip(F.replace(F.replace(out, F.lit("**"), F.lit("")), F.lit("`"), F.lit("")))


def strip_code_and_comments(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?sm)^```.*?^```", "")
    return F.regexp_replace(out, r"`[^`\n]+`", "")


def hashtags(text: Column, distinct: bool = False) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)#(\w+)"), 1)
    return F.array_distinct(found) if distinct else found


def slug_dash(text: Column) -> Column:
    """URL-decode, lower, runs of anything else to one dash."""
    decoded = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text, F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.lower(decoded), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_join(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def json_or_comma_list(value: Column) -> Column:
    """Array of trimmed, non-empty entries from JSON array text, or from a comma list."""
    raw = strip(F.coalesce(value, F.lit("")))
    looks_json = raw.startswith("[") & raw.endswith("]")
    parsed = F.when(looks_json, F.from_json(raw, "array<string>"))
    entries = F.coalesce(parsed, F.split(raw, ","))
    return F.filter(F.transform(entries, strip), lambda x: F.length(x) > 0)


def stable_key(*parts: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of the colon-joined parts (null counts as empty)."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def rolling_hash(text: Column) -> Column:
    """h = (h * 33) xor code, modulo 2^32, starting at 5381; last five decimal digits."""
    start = F.lit(5381).cast("bigint")
    # F.ascii gives the code point of the first character
    folded = F.aggregate(
        F.filter(F.split(text, ""), lambda ch: F.length(ch) > 0),
        start,
        lambda acc, ch: ((acc * 33).bitwiseXOR(F.ascii(ch).cast("bigint"))).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    return folded % 100000


def code_points(text: Column) -> Column:
    return F.char_length(text)


def within_limit(text: Column, limit: int) -> Column:
    return F.char_length(text) <= limit


def bounded(term: str) -> str:
    """Pattern for a term not glued to ASCII letters or digits."""
    return r"(?<![a-z0-9])" + re.escape(term) + r"(?![a-z0-9])"


def _term_test(body: Column, lowered: Column, term: str, case_bound: frozenset[str]) -> Column:
    """A cheap substring test runs before the pattern."""
    low = term.lower()
    if low not in case_bound:
        return F.contains(lowered, F.lit(low)) & lowered.rlike(bounded(low))
    test = F.lit(False)
    for form in sorted({low.title(), low.upper()}):
        pattern = r"(?<![A-Za-z0-9])" + re.escape(form) + r"(?![A-Za-z0-9])"
        test = test | (F.contains(body, F.lit(form)) & body.rlike(pattern))
    return test


def keyword_hits(text: Column, terms: Sequence[str], case_bound: frozenset[str] = frozenset()) -> Column:
    """Terms found in the text, in list order. The term list is a bounded parameter."""
    if not terms:
        return literal_array([])
    pair = F.struct(F.coalesce(text, F.lit("")).alias("body"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    return bind(pair, lambda t: F.array_compact(F.array(*[
        F.when(_term_test(t["body"], t["low"], term, case_bound), F.lit(term)) for term in terms])))
