"""Prose rules over a document corpus, as one findings table.

Every rule works inside the document's own row (array functions and patterns), so the corpus is
never shuffled; only the per-rule counts aggregate. Term lists and thresholds are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetric.functions.text import ALL_REST, LINE_BREAK, bind, compute_once, split_lines, strip

# Vocabularies and patterns of the prose rules.
BANNED_WORDS = (
    "delve", "leverage", "harness", "foster", "cultivate", "empower",
    "supercharge", "streamline", "utilize", "revolutionize", "unlock",
    "landscape", "tapestry", "beacon", "testament", "game-changer",
    "synergy", "paradigm", "plethora", "seamless", "multifaceted",
    "comprehensive", "robust", "bespoke", "innovative", "cutting-edge",
    "bleeding-edge",
)
BANNED_PHRASES = (
    "in today's fast-paced world",
    "in the realm of",
    "at its core",
    "it's not just x, it's y",
    "a double-edged sword",
    "in conclusion",
)
HYPE_WORDS = (
    "revolutionary", "groundbreaking", "transformative", "effortless",
    "world-class", "best-in-class", "game-changing", "unprecedented",
    "incredible", "amazing",
)
OPENERS = (
    "sure", "absolutely", "of course", "certainly", "in this article", "today we will",
    "let's dive", "let us dive", "welcome to",
)
CLAIM = (r"\b(always|never|guarantee(?:d)?|best|only|will|can|"
         r"increase(?:s|d)?|improve(?:s|d)?|reduce(?:s|d)?|save(?:s|d)?)\b")
EVIDENCE = (r"(\d|%|\baccording to\b|\bsource(?:d)?\b|\bmeasured\b|\bverified\b|"
            r"\btested\b|\bobserved\b|\bdata\b|\bstudy\b|\brecord\b|\bartifact\b)")
CLAIM_LABEL = (r"\b(fact|inference|recommendation|anecdote|hypothesis|we recommend|"
               r"we observed|our observation|in my experience)\b")
THESIS = (r"\b(the point is|the answer is|the problem is|the thesis is|"
          r"we recommend|you should|this means|the fix is|the goal is)\b")
PROMISE = (r"\b(fix your entire life|change everything|transform your life|"
           r"guaranteed success|achieve anything|works for everyone)\b")
SHAME = (r"\b(lazy|loser|weak|stupid|low-intelligence|pathetic|"
         r"if you disagree|you don't really want)\b")
ALIASES = {
    "founder": ("entrepreneur", "business owner"),
    "customer": ("client", "user", "buyer"),
    "workflow": ("process", "pipeline"),
    "website": ("site", "web presence"),
}
CANONICAL_NOTE = r"(?i)<!--\s*canonical-terms\s*:\s*(.*?)-->"
NOMINAL = r"(?U)\b[A-Za-z]+(?:tion|ment|ance|ence|ity|ness|ship)\b"
WORD = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9\"“‘])"
LIST_OR_QUOTE = r"^\s{0,3}(?:[-*+]|\d+[.)])\s+"
HEADING = r"^\s{0,3}#{1,6}\s+"
FENCE_LINE = r"(?m)^[ \t]*(?:```|~~~)[^\n]*$"

SEVERITY = {
    "W001": "warning", "W002": "warning", "W003": "warning", "W004": "warning", "W005": "warning",
    "W006": "warning", "W007": "info", "W008": "info", "W009": "info", "W010": "warning",
    "W011": "review", "W012": "review", "W013": "review", "W014": "review", "W015": "review",
    "W016": "review",
}
TEXT_LIMIT = 240


@dataclass(frozen=True)
class LintConfig:
    """Vocabulary and thresholds; the defaults are the house rules."""

    banned_words: Sequence[str] = BANNED_WORDS
    banned_phrases: Sequence[str] = BANNED_PHRASES
    hype_words: Sequence[str] = HYPE_WORDS
    openers: Sequence[str] = OPENERS
    claim: str = CLAIM
    evidence: str = EVIDENCE
    claim_label: str = CLAIM_LABEL
    thesis: str = THESIS
    promise: str = PROMISE
    shame: str = SHAME
    aliases: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(ALIASES))
    nominal: str = NOMINAL
    dash_chars: str = "—–"
    max_dashes: int = 2
    max_sentence_words: int = 45
    cadence_run: int = 5
    cadence_spread: int = 5
    max_paragraph_words: int = 120
    min_nominal_words: int = 40
    min_nominals: int = 5
    nominal_share: float = 0.08
    opening_lines: int = 8


def _any_case(pattern: str) -> str:
    return "(?iU)" + pattern


def mask_fences(text: Column) -> Column:
    """Blank out fenced blocks and their fence lines while keeping every line break.

    Cutting the text at its fence lines leaves prose in the even pieces and code in the odd ones,
    so the open/closed state needs no running scan.
    """
    pieces = F.split(F.regexp_replace(text, LINE_BREAK, "\n"), FENCE_LINE, -1)
    kept = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"[^\n]+", "")).otherwise(p))
    return F.array_join(kept, "")


def prose_lines(text: Column) -> Column:
    """array<struct<line, raw>> of the lines that are neither code, quote, comment nor blank."""
    numbered = F.transform(F.split(mask_fences(text), "\n", -1),
                           lambda raw, i: F.struct((i + 1).alias("line"), raw.alias("raw")))

    def visible(x: Column) -> Column:
        bare = strip(x["raw"])
        return (bare != "") & ~bare.startswith(">") & ~bare.startswith("<!--")

    return F.filter(numbered, visible)


def clean_line(raw: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(raw, LIST_OR_QUOTE, ""), HEADING, ""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def sentences(lines: Column) -> Column:
    """array<struct<line, text, words>> of the sentences of prose lines, in reading order."""
    return cleaned_sentences(F.transform(lines, cleaned))


def cleaned(x: Column) -> Column:
    return F.struct(x["line"].alias("line"), clean_line(x["raw"]).alias("text"))


def cleaned_sentences(lines: Column) -> Column:
    """The sentences of lines that are cleaned already."""
    def cut(x: Column) -> Column:
        parts = F.transform(F.split(x["text"], SENTENCE_GAP, -1), strip)
        return F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.struct(
            x["line"].alias("line"), s.alias("text"), word_count(s).alias("words")))

    return F.flatten(F.transform(lines, cut))


def paragraphs(text: Column) -> Column:
    """array<struct<line, text, words, lines, listed>> of blank-line separated blocks with prose in them."""
    blocks = F.split(F.regexp_replace(text, LINE_BREAK, "\n"), r"\n\s*\n", -1)

    def describe(block: Column) -> Column:
        listed = block.rlike(r"(?m)^\s*(?:[-*+]|\d+[.)])\s+")

        def with_text(lines: Column) -> Column:
            body = F.array_join(F.transform(lines, lambda x: clean_line(x["raw"])), " ")
            return bind(body, lambda t: F.struct(
                F.get(lines, F.lit(0))["line"].alias("line"), t.alias("text"), word_count(t).alias("words"),
                F.size(lines).alias("lines"), listed.alias("listed")))

        return bind(prose_lines(block), with_text)

    return F.filter(F.transform(blocks, describe), lambda p: p["lines"] > 0)


def first_even_run(lengths: Column, run: int, spread: int) -> Column:
    """0-based start of the first ``run`` neighbours whose lengths differ by at most ``spread``."""
    def search(ns: Column) -> Column:
        starts = F.when(F.size(ns) >= run, F.sequence(F.lit(0), F.size(ns) - run)).otherwise(F.array().cast("array<int>"))
        even = F.filter(starts, lambda i: F.array_max(F.slice(ns, i + 1, run))
                        - F.array_min(F.slice(ns, i + 1, run)) <= spread)
        return F.get(even, F.lit(0))

    return bind(lengths, search)


# What to do about a finding, by rule.
SUGGESTIONS = {
    "W001": "use a plain word", "W002": "say it directly", "W003": "begin with the point", "W004": "use fewer dashes", "W005": "end with a full stop",
    "W006": "split the sentence", "W007": "vary the sentence length", "W008": "split the paragraph", "W009": "use verbs", "W010": "show it or drop it",
    "W011": "add evidence", "W012": "say what kind of claim it is", "W013": "keep one term", "W014": "move the answer up", "W015": "promise less",
    "W016": "address the work, not the reader",
}


def finding(rule: str, line: Column, message: Column, text: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"),
                    line.cast("int").alias("line"), message.alias("message"),
                    F.substring(text, 1, TEXT_LIMIT).alias("text"), F.lit(SUGGESTIONS[rule]).alias("suggestion"))


def _per_line(lines: Column, rule: str, test, message) -> Column:
    """Findings of a line rule: ``test`` and ``message`` take the cleaned line."""
    return F.transform(F.filter(lines, lambda x: test(x["text"])),
                       lambda x: finding(rule, x["line"], message(x["text"]), x["text"]))


def _term_hits(lines: Column, rule: str, label: str, terms: Sequence[str], whole_word: bool) -> list[Column]:
    out = []
    for term in terms:
        low = term.lower()

        def test(text: Column, low: str = low) -> Column:
            found = F.contains(F.lower(text), F.lit(low))
            if whole_word:
                found = found & text.rlike(_any_case(r"\b" + re.escape(low) + r"\b"))
            return found

        out.append(_per_line(lines, rule, test, lambda _t, term=term: F.lit(f"{label}: {term}")))
    return out


def _pattern_rule(lines: Column, rule: str, message: str, *, hit: str, unless: Sequence[str] = ()) -> Column:
    def test(text: Column) -> Column:
        found = text.rlike(_any_case(hit))
        for pattern in unless:
            found = found & ~text.rlike(_any_case(pattern))
        return found

    return _per_line(lines, rule, test, lambda _t: F.lit(message))


def _one(condition: Column, item: Column) -> Column:
    return F.when(condition, F.array(item)).otherwise(F.array_except(F.array(item), F.array(item)))


def rule_columns(cfg: LintConfig) -> dict[str, Column]:
    """Findings array of each rule over the prepared columns lines, sents, paras and source."""
    lines, sents, paras, source = (F.col(c) for c in ("lines", "sents", "paras", "source_text"))
    first = F.get(lines, F.lit(0))
    none = F.lit("")
    opening = F.greatest(F.lit(1), F.floor((F.size(lines) + 4) / 5).cast("int"))
    later = F.slice(lines, opening + 1, F.greatest(F.size(lines), F.lit(1)))
    claims = _any_case(cfg.claim)
    late_thesis = (
        (F.size(lines) >= cfg.opening_lines)
        & ~F.exists(F.slice(lines, 1, opening), lambda x: x["text"].rlike(_any_case(cfg.thesis)))
        & F.exists(later, lambda x: x["text"].rlike(claims)))
    opener = _any_case("^(" + "|".join(re.escape(o) for o in cfg.openers) + r")\b")
    dashes = F.length(source) - F.length(F.translate(source, cfg.dash_chars, ""))
    run_at = first_even_run(F.transform(sents, lambda s: s["words"]), cfg.cadence_run, cfg.cadence_spread)
    run = F.slice(sents, F.coalesce(run_at, F.lit(0)) + 1, cfg.cadence_run)

    def nominals(p: Column) -> Column:
        return F.regexp_count(p["text"], F.lit(cfg.nominal))

    declared = F.transform(F.split(F.lower(F.regexp_extract(source, CANONICAL_NOTE, 1)), ","), strip)
    drift = []
    for term in sorted(cfg.aliases):
        for alias in cfg.aliases[term]:
            seen = (F.array_contains(declared, term)
                    & source.rlike(_any_case(r"\b" + re.escape(term) + r"\b"))
                    & source.rlike(_any_case(r"\b" + re.escape(alias) + r"\b")))
            drift.append(_one(seen, finding("W013", F.lit(None), F.lit(
                f"shifting term: {term} to {alias}"),
                F.regexp_extract(source, _any_case(r"\b(" + re.escape(alias) + r")\b"), 1))))

    claim_text = lambda p: F.concat(F.lit("large promise: "), F.regexp_extract(p, _any_case(cfg.promise), 1))
    return {
        "W001": F.concat(*_term_hits(lines, "W001", "inflated word", cfg.banned_words, True)),
        "W002": F.concat(*_term_hits(lines, "W002", "worn phrase",
                                     cfg.banned_phrases, False)),
        "W003": _one(F.coalesce(first["text"].rlike(opener), F.lit(False)), finding(
            "W003", first["line"], F.lit("slow opening"), first["text"])),
        "W004": _one(dashes > cfg.max_dashes, finding(
            "W004", F.lit(None), F.concat(F.lit("dashes: "), dashes.cast("string")), none)),
        "W005": _per_line(lines, "W005", lambda t: F.contains(t, F.lit("!")),
                          lambda _t: F.lit("exclamation mark")),
        "W006": F.transform(F.filter(sents, lambda s: s["words"] > cfg.max_sentence_words),
                            lambda s: finding("W006", s["line"], F.concat(
                                F.lit("long sentence: "), s["words"].cast("string")), s["text"])),
        "W007": _one(run_at.isNotNull(), finding(
            "W007", F.get(run, F.lit(cfg.cadence_run - 1))["line"],
            F.lit("even sentence lengths"),
            F.array_join(F.transform(run, lambda s: s["text"]), " | "))),
        "W008": F.transform(
            F.filter(paras, lambda p: (p["words"] > cfg.max_paragraph_words) & (p["lines"] <= 1) & ~p["listed"]),
            lambda p: finding("W008", p["line"], F.concat(
                F.lit("long paragraph: "), p["words"].cast("string")),
                p["text"])),
        "W009": F.transform(
            F.filter(paras, lambda p: (p["words"] >= cfg.min_nominal_words) & (nominals(p) >= cfg.min_nominals)
                     & (nominals(p) / F.greatest(p["words"], F.lit(1)) > cfg.nominal_share)),
            lambda p: finding("W009", p["line"], F.concat(
                F.lit("many abstract nouns: "), nominals(p).cast("string")),
                p["text"])),
        "W010": F.concat(*_term_hits(lines, "W010", "hype word", cfg.hype_words, True)),
        "W011": _pattern_rule(lines, "W011", "claim without evidence",
                              hit=cfg.claim, unless=(cfg.evidence,)),
        "W012": _pattern_rule(lines, "W012", "claim without label",
                              hit=cfg.claim, unless=(cfg.evidence, cfg.claim_label)),
        "W013": F.concat(*drift) if drift else F.array().cast(FINDINGS_TYPE),
        "W014": _one(late_thesis, finding(
            "W014", F.get(later, F.lit(0))["line"],
            F.lit("late thesis"),
            F.get(later, F.lit(0))["text"])),
        "W015": _per_line(lines, "W015", lambda t: t.rlike(_any_case(cfg.promise)), claim_text),
        "W016": _pattern_rule(lines, "W016", "shaming word", hit=cfg.shame),
    }


FINDINGS_TYPE = "array<struct<rule:string,severity:string,line:int,message:string,text:string,suggestion:string>>"


def lint(documents: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[str] | None = None,
         cfg: LintConfig | None = None) -> DataFrame:
    """Findings of the chosen rules, one row each: key, rule, severity, line, message, text, suggestion."""
    cfg = cfg or LintConfig()
    chosen = list(rules or SEVERITY)
    source = F.col("source_text")
    prepared = documents.select(key, F.col(text).alias("source_text"))
    # lines are found and cleaned once, for the rules of lines and of sentences
    prepared = compute_once(prepared, lines=F.filter(F.transform(prose_lines(source), cleaned), lambda x: x["text"] != ""))
    prepared = prepared.select(key, "source_text", "lines", cleaned_sentences(F.col("lines")).alias("sents"), paragraphs(source).alias("paras"))
    columns = rule_columns(cfg)
    parts = [columns[r].cast(FINDINGS_TYPE) for r in chosen]
    merged = reduce(lambda a, b: F.concat(a, b), parts)
    return prepared.select(key, F.explode(merged).alias("f")).select(key, "f.*")


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("findings"))


def findings_status(findings: DataFrame) -> DataFrame:
    """One row: number of findings and whether any of them is an error."""
    return findings.agg(F.count(F.lit(1)).alias("findings"),
                        F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("failed"))


# ---- outreach notes -------------------------------------------------------

# Phrases outreach must not use, and the heading of the length-limited note.
OUTREACH_PHRASES = (
    r"\bjust\s+following\s+up\b",
    r"\bbumping\s+this\b",
    r"\b(?:quick\s+)?3-point\s+scan\b",
    r"\bwebsite\s+(?:audit|scan)\b",
    r"\bchecking\s+in\b",
    r"\bhope\s+(?:this\s+email\s+)?finds\s+you\s+well\b",
    r"\bpick\s+your\s+brain\b",
)
NOTE_HEADING = r"(?i)###\s+Connection\s+Request\s+Note"
NOTE_LIMIT = 200


def outreach_findings(documents: DataFrame, key: str = "doc_id", text: str = "text",
                      phrases: Sequence[str] = OUTREACH_PHRASES, long_dash: str = "—",
                      note_limit: int = NOTE_LIMIT, note_heading: str = NOTE_HEADING) -> DataFrame:
    """Long dashes, banned phrases and over-long connection notes: key, kind, line, detail."""
    numbered = F.transform(split_lines(F.col(text)), lambda raw, i: F.struct(
        (i + 1).alias("line"), raw.alias("raw")))
    dash = F.transform(F.filter(numbered, lambda x: F.contains(x["raw"], F.lit(long_dash))), lambda x: F.struct(
        F.lit("dash").alias("kind"), x["line"].alias("line"), F.lit(long_dash).alias("detail")))
    def phrase_hits(pattern: str) -> Column:
        return F.transform(F.filter(numbered, lambda x: x["raw"].rlike(pattern)), lambda x: F.struct(
            F.lit("phrase").alias("kind"), x["line"].alias("line"),
            F.regexp_extract(x["raw"], pattern, 0).alias("detail")))

    parts = [dash] + [phrase_hits(_any_case(p)) for p in phrases]
    # a note runs from its heading to the next heading or rule; cutting at the headings gives the notes
    flat = F.regexp_replace(F.col(text), LINE_BREAK, "\n")
    cut = F.split(flat, "(?m)(?=^[^\n]*" + note_heading + ")", -1)

    def starts(pieces: Column) -> Column:
        # a piece starts on the line after all line breaks of the pieces before it
        lines_before = F.aggregate(pieces, F.array(F.lit(1)), lambda ns, p: F.array_append(
            ns, F.element_at(ns, -1) + F.regexp_count(p, F.lit("\n"))))
        return F.arrays_zip(lines_before.alias("line"), pieces.alias("piece"))

    notes = F.filter(bind(cut, starts), lambda s: s["piece"].rlike("^[^\n]*" + note_heading))

    def note(s: Column) -> Column:
        def measure(body: Column) -> Column:
            stops = F.filter(F.transform(body, lambda raw, i: F.when(raw.rlike("^(### |---|## )"), i)),
                             lambda i: i.isNotNull())
            inner = F.slice(body, 1, F.coalesce(F.array_min(stops), F.size(body)))
            kept = F.filter(inner, lambda raw: (strip(raw) != "") & (strip(raw).startswith(">") | ~raw.startswith("#")))
            joined = F.array_join(F.transform(kept, lambda raw: strip(F.regexp_replace(strip(raw), "^>+", ""))), " ")
            return F.length(strip(F.regexp_replace(strip(joined), r"^>\s*", ""))).cast("string")

        body = F.slice(F.split(s["piece"], "\n", -1), 2, ALL_REST)
        return F.struct(F.lit("note").alias("kind"), s["line"].alias("line"), bind(body, measure).alias("detail"))

    parts.append(F.filter(F.transform(notes, note), lambda n: n["detail"].cast("int") > note_limit))
    kind = "array<struct<kind:string,line:int,detail:string>>"
    merged = reduce(lambda a, b: F.concat(a, b), [p.cast(kind) for p in parts])
    return documents.select(key, F.explode(merged).alias("f")).select(key, "f.*")


# ---- transcripts ----------------------------------------------------------

def clean_transcript(text: Column) -> Column:
    """Subtitle text as prose: no blank, numeric or time lines, no tags, no repeat of the line before."""
    lines = F.transform(F.split(text, "\n", -1), strip)
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d+$") & ~x.rlike(r"^\d{2}:\d{2}:\d{2}"))
    bare = F.transform(kept, lambda x: F.regexp_replace(x, "<[^>]+>", ""))
    fresh = drop_repeats(bare)
    return F.regexp_replace(F.array_join(fresh, " "), r"\s+", " ")


def drop_repeats(lines: Column) -> Column:
    """Entries that differ from the entry before them (the first is compared with an empty line)."""
    return bind(lines, lambda ls: F.filter(
        ls, lambda x, i: x != F.when(i == 0, F.lit("")).otherwise(F.get(ls, i - 1))))


# ---- scans ----------------------------------------------------------------

# Substrings that mark a risky file, and the file types that are read.
RISKY = (
    "rm -rf", "sudo ", "curl ", "wget ", "chmod 777", "eval(", "exec(", "subprocess", "os.system",
    "OPENAI_API_KEY", "ANTHROPIC_API_KEY", "password", "secret", "token", "ignore previous", "bypass",
)
TEXT_TYPES = (".md", ".py", ".sh", ".js", ".ts", ".json", ".yaml", ".yml", ".txt")


def risk_flags(files: DataFrame, key: str, text: str, patterns: Sequence[str] = RISKY,
               path: str | None = None, scan_chars: int | None = None) -> DataFrame:
    """(key, pattern) for each risky substring; whole texts unless ``scan_chars`` sets the scanned length."""
    df = files
    if path:
        suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
        df = df.filter(suffix.isin(*TEXT_TYPES))
    body = F.lower(F.substring(text, 1, scan_chars) if scan_chars else F.col(text))
    hits = F.array_compact(F.array(*[F.when(F.contains(body, F.lit(p.lower())), F.lit(p)) for p in patterns]))
    return df.select(key, F.explode(hits).alias("pattern"))

