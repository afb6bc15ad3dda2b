"""Markdown sources: tables, sections with records, front matter, file inventories.

Documents are rows; everything inside a document is done with array functions on that row, so a
corpus is read without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetric.functions.text import ALL_REST, bind, compute_once, split_lines, strip, strip_markup

# Header names of the two tables of the brief.
NETWORK_HEADERS = {
    "name": ("contact", "name"),
    "org": ("current organization", "organization", "org", "company"),
    "relationship": ("relationship",),
    "focus": ("focus",),
    "status": ("status",),
    "last_touch": ("last touch", "last contact"),
    "next_action": ("next action", "next step"),
}
STAGE_HEADERS = {
    "company": ("company",),
    "role": ("role",),
    "status": ("status",),
    "score": ("score",),
    "positioning": ("positioning",),
    "next_action": ("next action", "next step"),
    "follow_up": ("follow-up", "follow up", "followup"),
}
RULE_LINE = r"^\s*\|[\s:\-|]+\|?\s*$"
ROW_LINE = r"^\s*\|"


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Whole text files as (path, text)."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def cells(line: Column) -> Column:
    """Cells of a table row; a backslash keeps a pipe inside its cell; markup is removed."""
    bare = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|", -1),
                       lambda c: strip_markup(F.replace(c, F.lit("\\|"), F.lit("|"))))


def _blocks(text: Column) -> Column:
    """array<array<string>>: every run of table lines that starts with a header and a rule line."""
    marked = F.array_join(F.transform(split_lines(text), lambda x: F.when(x.rlike(ROW_LINE), x).otherwise(F.lit("\x01"))), "\n")
    runs = F.transform(F.split(marked, "(?:^|\n)\x01", -1), lambda run: F.filter(F.split(run, "\n", -1), lambda x: x != ""))

    def from_header(run: Column) -> Column:
        rules = F.filter(F.transform(run, lambda x, i: F.when(x.rlike(RULE_LINE) & (i > 0), i)), lambda i: i.isNotNull())
        first = F.array_min(rules)
        return F.when(first.isNotNull(), F.slice(run, first, F.size(run)))

    return F.filter(F.transform(runs, from_header), lambda b: b.isNotNull())


def first_table(documents: DataFrame, headers: Mapping[str, Sequence[str]], required: Sequence[str],
                key: str = "path", text: str = "text") -> DataFrame:
    """Rows of each document's first table that has the required columns: key, position and one column per name.

    Header names may vary; short rows are padded; a column the table lacks is empty.
    """
    def place(head: Column, names: Sequence[str]) -> Column:
        found = F.filter(F.transform(head, lambda h, i: F.when(F.lower(h).isin(*names), i)), lambda i: i.isNotNull())
        return F.array_min(found)

    def describe(block: Column) -> Column:
        return bind(cells(F.get(block, F.lit(0))), lambda head: F.struct(
            *[place(head, names).alias(name) for name, names in headers.items()],
            F.slice(block, 3, F.size(block)).alias("rows")))

    tables = F.filter(F.transform(_blocks(F.col(text)), describe),
                      lambda t: F.array_size(F.array_compact(F.array(*[t[r] for r in required]))) == len(required))
    chosen = compute_once(documents, t=F.get(tables, F.lit(0))).select(key, "t").filter("t IS NOT NULL")
    rows = chosen.select(key, "t", F.posexplode("t.rows").alias("position", "line"))
    parts = rows.select(key, "t", "position", cells(F.col("line")).alias("c"))
    return parts.select(key, "position", *[
        F.coalesce(F.get("c", F.col(f"t.{name}")), F.lit("")).alias(name) for name in headers])


def sections(documents: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, heading, body) of the level-two sections; of repeated headings the first counts."""
    flat = F.regexp_replace(text, r"\r\n?", "\n")
    pieces = F.slice(F.split(F.concat(F.lit("\n"), flat), r"\n##[ \t]+(?!#)", -1), 2, ALL_REST)
    parts = F.transform(pieces, lambda p: F.struct(
        F.lower(strip(F.regexp_extract(p, r"^([^\n]*)", 1))).alias("heading"), F.regexp_replace(p, r"^[^\n]*\n?", "").alias("body")))
    firsts = bind(parts, lambda ps: bind(F.transform(ps, lambda s: s["heading"]), lambda names: F.filter(
        ps, lambda s, i: F.array_position(names, s["heading"]) == i + 1)))
    return documents.select(key, F.explode(firsts).alias("s")).select(key, "s.*")


def records(section_rows: DataFrame, fields: Mapping[str, str], key: str = "path", body: str = "body") -> DataFrame:
    """Level-three records of section bodies: title and the first match of each field pattern."""
    pieces = F.slice(F.split(F.concat(F.lit("\n"), F.col(body)), r"\n###[ \t]+", -1), 2, ALL_REST)
    rows = section_rows.select(key, F.posexplode(pieces).alias("position", "r"))
    title = strip(F.regexp_extract("r", r"^([^\n]*)", 1))
    out = rows.select(key, "position", title.alias("title"), *[
        F.nullif(strip(F.regexp_extract("r", pattern, 1)), F.lit("")).alias(name) for name, pattern in fields.items()])
    return out.filter(~F.contains("title", F.lit("—")))  # a long dash marks a template


# Labelled fields of a contact record.
RECORD_FIELDS = {
    "url": r"(https://www\.linkedin\.com/in/[^\s)\"']+)",
    "location": r"\*\*Location:\*\*\s*([^\n]+)",
    "headline": r"\*\*(?:Current headline|Current role):\*\*\s*([^\n]+)",
    "company": r"\*\*(?:Company|Company shown):\*\*\s*([^\n]+)",
    "relationship": r"\*\*Relationship:\*\*\s*([^\n]+)",
}


def front_matter(documents: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, data map, body). Lines without a key continue the value before them."""
    parts = F.split(F.col(text), "---", 3)
    has = F.col(text).startswith("---") & (F.size(parts) == 3)
    raw = strip(F.get(parts, F.lit(1)))
    # a line that starts a key opens an entry; cutting before such lines keeps continuation lines with it
    entries = F.split(F.regexp_replace(raw, r"\n[ \t]*(?=\n)", ""), r"\n(?=[A-Za-z0-9_-]+:)", -1)
    keyed = F.filter(entries, lambda e: e.rlike("^[A-Za-z0-9_-]+:"))

    def value(e: Column) -> Column:
        first = F.regexp_replace(F.regexp_replace(strip(F.regexp_extract(e, r"^[^:]+:([^\n]*)", 1)), '^"+|"+$', ""), "^'+|'+$", "")
        return F.concat(first, F.regexp_extract(e, r"(?s)^[^\n]*(\n.*)$", 1))

    pairs = F.transform(keyed, lambda e: F.struct(F.regexp_extract(e, "^([A-Za-z0-9_-]+):", 1).alias("k"), value(e).alias("v")))
    # a repeated key keeps its last value
    last = bind(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda o: o["k"] == p["k"])))
    empty = F.create_map().cast("map<string,string>")
    return documents.select(
        key, F.when(has, F.map_from_entries(last)).otherwise(empty).alias("data"),
        F.when(has, strip(F.get(parts, F.lit(2)))).otherwise(F.col(text)).alias("body"))


# ---- files ------------------------------------------------------------------------

# Keyword sets of the folder classes.
AGENT_WORDS = ("claude", "codex", "gemini", "cursor", "opencode", "@workspace", "antigravity", "chatgpt")
SETUP_WORDS = ("npm run", "yarn", "pnpm", "docker", "make install")
CLASS_NAMES = ("safe to migrate", "adaptable", "stays as is")


def read_files(spark: SparkSession, root: str, pattern: str = "*", partitions: bool = False) -> DataFrame:
    """Files below a folder: path, file_name, length, text (empty for files that are not UTF-8).

    Spark's file sources list no files without content, so an empty file gives no row. With ``partitions`` folders
    named ``key=value`` give columns, and filters on these skip whole folders; otherwise folders of any depth are read.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = (reader if partitions else reader.option("recursiveFileLookup", "true")).load(root)
    keys = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select("path", F.col("_metadata.file_name").alias("file_name"), "length",
                        F.coalesce(F.try_validate_utf8("content"), F.lit("")).alias("text"), *[F.col(f"`{k}`") for k in keys])


def inventory(files: DataFrame, folder: Column, subfolders: Sequence[str] = ("scripts", "references", "assets"),
              main_file: str = "SKILL.md") -> DataFrame:
    """Per folder: number of files, lines, whether the main file and the usual subfolders are there."""
    lines = F.when(F.col("text") == "", 0).otherwise(
        F.size(split_lines(F.regexp_replace("text", r"(\r\n|\n|\r)$", ""))))
    rest = F.col("path")
    return files.withColumn("folder", folder).groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"), F.sum(lines).alias("lines"),
        F.bool_or(rest.endswith("/" + main_file)).alias("has_main"),
        *[F.bool_or(F.contains(rest, F.lit(f"/{s}/"))).alias(f"has_{s}") for s in subfolders])


def folder_classes(files: DataFrame, folder: str, text: str, agent_words: Sequence[str] = AGENT_WORDS,
                   setup_words: Sequence[str] = SETUP_WORDS) -> DataFrame:
    """Class of each folder from the keywords anywhere in its text files.

    Each file keeps only its hits, one flag per keyword; a folder with very many files aggregates map-side.
    """
    low = F.lower(F.col(text))
    flags = {w: F.contains(low, F.lit(w)) for w in [*agent_words, *setup_words]}
    marked = files.select(folder, *[flag.alias(f"_{i}") for i, flag in enumerate(flags.values())])
    seen = marked.groupBy(folder).agg(*[F.bool_or(f"_{i}").alias(f"_{i}") for i in range(len(flags))])

    def hits(words: Sequence[str], start: int) -> Column:
        return F.array_compact(F.array(*[F.when(F.col(f"_{start + i}"), F.lit(w)) for i, w in enumerate(words)]))

    agents, setup = hits(agent_words, 0), hits(setup_words, len(agent_words))
    name = (F.when(F.size(setup) > 0, CLASS_NAMES[2]).when(F.size(agents) > 0, CLASS_NAMES[1]).otherwise(CLASS_NAMES[0]))
    return seen.select(folder, name.alias("category"), agents.alias("agent_words"), setup.alias("setup_words"))


