"""Mail audit: header projection, keep policy, storage by domain and year, sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetric.functions.dates import year_text
from quillmetric.functions.text import compute_once

# Default keep policy.
PROTECTED_LABELS = ("SENT", "STARRED", "IMPORTANT")
KEEP_EXTENSIONS = ("pdf", "mp3")
TOP_GROUPS = 50
TOP_MESSAGES = 50


def header(headers: Column, name: str) -> Column:
    """Value of the first header with this name in any case; empty when absent."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


def sender_domain(sender: Column) -> Column:
    """Domain of the address in angle brackets, else of the first bare address; empty when there is none."""
    bracket = F.regexp_extract(sender, r"<([^>]+)>", 1)
    bare = F.regexp_extract(sender, r"([^\s<>@]+@[^\s<>]+)", 1)
    address = F.lower(F.when(bracket != "", bracket).otherwise(bare))
    return F.when(F.contains(address, F.lit("@")),
                  F.regexp_replace(F.substring_index(address, "@", -1), "[>,)]*$", "")).otherwise(F.lit(""))


def normalise(messages: DataFrame) -> DataFrame:
    """Raw messages (id, thread_id, label_ids, size_estimate, internal_date, snippet, headers) to audit rows."""
    heads = {name: header(F.col("headers"), title) for name, title in (("sender", "From"), ("subject", "Subject"), ("date", "Date"))}
    return compute_once(messages, **heads).select(
        "id", "thread_id", F.coalesce("label_ids", F.array().cast("array<string>")).alias("label_ids"),
        F.coalesce("size_estimate", F.lit(0)).cast("bigint").alias("bytes"),
        year_text(F.col("internal_date"), F.col("date")).alias("year"),
        "sender", sender_domain(F.col("sender")).alias("domain"), "subject", "date",
        F.coalesce("snippet", F.lit("")).alias("snippet"))


def protection_reasons(labels: Sequence[str] = PROTECTED_LABELS, terms: Sequence[str] = (),
                       domains: Sequence[str] = (), extensions: Sequence[str] = KEEP_EXTENSIONS) -> Column:
    """Why a message is kept: policy lists are small parameters, tested as constant columns."""
    # needles are fixed text, so a case-folded haystack is tested with plain substring search
    hay = F.lower(F.concat_ws(" ", "sender", "subject", "snippet"))
    tests = [F.when(F.array_contains("label_ids", v), F.lit(f"label:{v}")) for v in labels]
    tests += [F.when(F.contains(hay, F.lit(v.lower())), F.lit(f"term:{v}")) for v in terms]
    for value in domains:
        low = value.lower()
        same = (F.col("domain") == low) | F.col("domain").endswith("." + low)
        tests.append(F.when(same, F.lit(f"domain:{value}")))
    for value in extensions:
        bare = value.lower().removeprefix(".")
        named = F.contains(hay, F.lit("." + bare)) | F.contains(hay, F.lit("filename:" + bare))
        tests.append(F.when(named, F.lit(f"extension:{value}")))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def classify(rows: DataFrame, **policy: Sequence[str]) -> DataFrame:
    return compute_once(rows, reasons=protection_reasons(**policy)).withColumn("held", F.size("reasons") > 0)


def filter_options(options: Mapping[str, object], today) -> Column:
    """One predicate from listing options: older/newer than days, category, label, domain, size, attachment."""
    test = F.lit(True)
    limit = {k: options.get(k) for k in ("older_than_days", "newer_than_days")}
    if limit["older_than_days"] is not None:
        test = test & (F.col("sent_on") < F.date_sub(F.lit(str(today)).cast("date"), int(limit["older_than_days"])))
    if limit["newer_than_days"] is not None:
        test = test & (F.col("sent_on") > F.date_sub(F.lit(str(today)).cast("date"), int(limit["newer_than_days"])))
    if options.get("category"):
        test = test & (F.col("category") == options["category"])
    if options.get("label"):
        test = test & F.array_contains("label_ids", options["label"])
    if options.get("from_domain"):
        test = test & (F.col("domain") == str(options["from_domain"]).lower())
    if options.get("larger_than") is not None:
        test = test & (F.col("bytes") > int(options["larger_than"]))
    if options.get("has_attachment") is not None:
        test = test & (F.col("has_attachment") == bool(options["has_attachment"]))
    return test


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1024.0) / F.lit(1024.0), 2)


def bytes_by_group(rows: DataFrame, keys: Sequence[str] = ("domain", "year"), top: int = TOP_GROUPS) -> DataFrame:
    """Messages and bytes by each key on its own, in one pass, and the largest groups of each."""
    filled = rows.select(*[F.coalesce(F.col(k).cast("string"), F.lit("(unknown)")).alias(k) for k in keys], "bytes")
    grouped = filled.groupingSets([[k] for k in keys], *keys).agg(
        F.count(F.lit(1)).alias("messages"), F.sum("bytes").alias("bytes"),
        *[F.grouping(k).alias(f"_{k}") for k in keys])
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        kind = F.when(F.col(f"_{k}") == 0, F.lit(k)).otherwise(kind)
        value = F.when(F.col(f"_{k}") == 0, F.col(k)).otherwise(value)
    named = grouped.select(kind.alias("grouped_by"), value.alias("group_value"), "messages", "bytes")
    order = Window.partitionBy("grouped_by").orderBy(F.desc("bytes"), F.desc("messages"), F.col("group_value"))
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.withColumn("size_mb", megabytes(F.col("bytes")))


def audit_summary(rows: DataFrame) -> DataFrame:
    """One row: candidate, held and error counts and bytes. Error rows carry a non-null error."""
    fine = F.col("error").isNull()
    return rows.agg(
        F.count_if(fine & ~F.col("held")).alias("candidates"),
        F.coalesce(F.sum(F.when(fine & ~F.col("held"), F.col("bytes"))), F.lit(0)).alias("candidate_bytes"),
        F.count_if(fine & F.col("held")).alias("held"),
        F.coalesce(F.sum(F.when(fine & F.col("held"), F.col("bytes"))), F.lit(0)).alias("held_bytes"),
        F.count_if(~fine).alias("errors"))


def compact(rows: DataFrame) -> DataFrame:
    return rows.select("id", "thread_id", megabytes(F.col("bytes")).alias("size_mb"), "year", "domain", "subject", "label_ids")


def largest(rows: DataFrame, n: int = TOP_MESSAGES) -> DataFrame:
    return rows.orderBy(F.desc("bytes"), F.col("id")).limit(n)


def write_audit(rows: DataFrame, out: str) -> dict[str, str]:
    """Write the five audit tables. The classified rows are written once and the reports read that copy."""
    paths = {name: f"{out.rstrip('/')}/{name}" for name in ("classified", "summary", "candidates", "held", "ids", "errors")}
    rows.write.mode("overwrite").parquet(paths["classified"])
    done = rows.sparkSession.read.parquet(paths["classified"])
    fine = done.filter("error IS NULL")
    audit_summary(done).write.mode("overwrite").json(paths["summary"])
    compact(fine.filter("NOT held")).write.mode("overwrite").parquet(paths["candidates"])
    compact(fine.filter("held")).write.mode("overwrite").parquet(paths["held"])
    fine.filter("NOT held").select("id").write.mode("overwrite").text(paths["ids"])
    done.filter("error IS NOT NULL").select("id", "error").write.mode("overwrite").json(paths["errors"])
    return paths
