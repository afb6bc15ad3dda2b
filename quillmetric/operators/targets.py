"""Keyword targets: tiered term lists from profile documents, stage tables and overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetric.functions.people import clean_company
from quillmetric.functions.text import strip
from quillmetric.operators.outreach import ACTIVE_POINTS

# Terms too general to count, product names that do count, and seniority words.
STOP_TERMS = (
    "js", "javascript", "rest apis", "rest api", "node.js", "nodejs", "graphql", "react", "typescript",
    "tailwind css", "tailwind", "ci/cd", "github actions",
)
PRODUCT_NAMES = ("segment", "onetrust", "hubspot", "marketo", "salesforce", "zoominfo", "optimizely", "mparticle", "6sense")
SENIORITY = r"(?i)^(principal|senior|sr\.?|staff|lead|junior|jr\.?)\s+"
# capability label to tier: product names of the growth line are raised, everything else there stays in c
LABEL_TIERS = {"platforms & cms": "tier_b", "growth & measurement": "tier_c", "quality & delivery": "tier_c", "web engineering": "tier_c"}


def profile_terms(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, term, pos) of a profile: role titles, and listed capabilities under their label."""
    head = F.regexp_extract(text, r"(?m)^\*\*(.+?)\*\*\s*$", 1)
    titles = F.concat(
        F.transform(F.split(head, r"\|"), strip),
        F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^###\s+\*\*(.+?)\*\*"), 1),
                    lambda t: strip(F.regexp_replace(t, r"\s*\([^)]*\)", ""))))
    lines = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*-\s+\*\*.+?:\*\*\s*.+$"), 0)
    pattern = r"^\s*-\s+\*\*(.+?):\*\*\s*(.+)$"

    def listed(line: Column) -> Column:
        label = F.lower(strip(F.regexp_extract(line, pattern, 1)))
        return F.transform(F.split(F.regexp_extract(line, pattern, 2), ","), lambda t: F.struct(label.alias("kind"), strip(t).alias("term")))

    title_rows = F.transform(titles, lambda t: F.struct(F.lit("title").alias("kind"), t.alias("term")))
    both = F.concat(title_rows, F.flatten(F.transform(lines, listed)))
    rows = documents.select(key, F.posexplode(both).alias("pos", "t")).select(key, "t.kind", "t.term", "pos")
    return rows.filter("term <> ''")


def tiered_terms(terms: DataFrame, key: str, stop: Sequence[str] = STOP_TERMS, products: Sequence[str] = PRODUCT_NAMES) -> DataFrame:
    """(key, tier, term, pos): role titles and platforms in tier b, the rest in tier c, stop terms left out.

    Titles also count without their seniority word, and as they are written in ``role_titles``. A profile with titles
    also looks for "hiring", and for "nextjs" where it names next.js. Of repeated terms the first position stays.
    """
    low = F.lower("term")
    bare = F.regexp_replace(low, SENIORITY, "")
    is_product = low.isin(*products)
    tier = F.when(F.col("kind") == "title", "tier_b")
    for label, name in LABEL_TIERS.items():
        tier = tier.when((F.col("kind") == label) & (F.lit(name) == "tier_c") & (F.lit(label) == "growth & measurement") & is_product,
                         "tier_b").when(F.col("kind") == label, name)
    platform = (F.col("kind") == "platforms & cms") | ((F.col("kind") == "growth & measurement") & is_product)
    entries = F.array_compact(F.array(
        F.when(tier.isNotNull(), F.struct(tier.alias("tier"), low.alias("term"))),
        F.when((F.col("kind") == "title") & (bare != low) & (bare != ""), F.struct(F.lit("tier_b").alias("tier"), bare.alias("term"))),
        F.when(platform, F.struct(F.lit("platform_terms").alias("tier"), low.alias("term")))))
    titled = F.max(F.when(F.col("kind") == "title", 1)).over(Window.partitionBy(key)).isNotNull()
    always = F.array_compact(F.array(
        F.when(F.col("kind") == "title", F.struct(F.lit("tier_c").alias("tier"), F.lit("hiring").alias("term"))),
        F.when((tier == "tier_c") & (low == "next.js"), F.struct(F.lit("tier_c").alias("tier"), F.lit("nextjs").alias("term"))),
        F.when(F.col("kind") == "title", F.struct(F.lit("role_titles").alias("tier"), F.col("term").alias("term")))))
    rows = terms.withColumn("_titled", titled).filter("_titled").select(key, "pos", F.explode(F.concat(entries, always)).alias("e")).select(
        key, "e.tier", "e.term", "pos")
    kept = rows.filter(~F.col("term").isin(*stop)) if stop else rows
    return kept.groupBy(key, "tier", "term").agg(F.min("pos").alias("pos"))


def company_terms(stages: DataFrame, key: str) -> DataFrame:
    """(key, tier, term, pos) of companies of active rows: name parts around '/', and a former name in brackets."""
    raw = F.col("company")
    former = F.regexp_extract_all(raw, F.lit(r"(?i)\(formerly\s+([^)]+)\)"), 1)
    parts = F.concat(F.split(F.regexp_replace(raw, r"\([^)]*\)", ""), "/"), F.flatten(F.transform(former, lambda f: F.split(f, "/"))))
    names = F.filter(F.transform(parts, lambda p: clean_company(strip(p))), lambda n: n != "")
    active = stages.filter(F.col("state").isin(*ACTIVE_POINTS))
    rows = active.select(key, F.col("row_id").alias("pos"), F.explode(names).alias("term"))
    firsts = rows.groupBy(key, "term").agg(F.min("pos").alias("pos"))
    slug = F.regexp_replace("term", r"\s+", "-")
    both = F.array(F.struct(F.lit("tier_a").alias("tier"), F.col("term").alias("t")), F.struct(F.lit("company_slugs").alias("tier"), slug.alias("t")))
    return firsts.select(key, "pos", F.explode(both).alias("e")).select(key, "e.tier", F.col("e.t").alias("term"), "pos")


def with_override(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """A tier that the override has for a key replaces the derived tier as a whole."""
    given = override.select(key, "tier").distinct()
    return base.join(given, [key, "tier"], "left_anti").unionByName(override)
