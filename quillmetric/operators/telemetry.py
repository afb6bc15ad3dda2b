"""Failure ledger: categories, missing programs, consecutive failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Category without a name, the missing-program note and the breaker threshold.
DEFAULT_CATEGORY = "GENERIC_TOOL_FAILURE"
MISSING_PROGRAM = "MISSING_BINARY"
MISSING_NOTE = r"Binary '([^']+)' was not found"
BREAK_AT = 2

# Categories that have a standing rule, with the rule's title.
RULE_TITLES = {
    "INVALID_ARTIFACT_METADATA": "Artifact Scope",
    "FILE_WRITE_EXISTING": "File Mutation",
    "EDIT_TARGET_NOT_FOUND": "Precision Editing",
    "EDIT_MULTIPLE_MATCHES": "Edit Windowing",
    "VIEW_RANGE_EXCEEDED": "View Windowing",
    "SEARCH_TIMEOUT_BROAD": "Targeted Search",
    "WEB_ACCESS_BLOCKED": "Stealth Web Access",
    "MISSING_BINARY": "CLI Environment",
    "SANDBOX_SSH_RESTRICTION": "Git Remote Transport",
    "PYTHON_QUOTE_SYNTAX_ERROR": "Inline Scripting",
    "CWD_OR_MODULE_MISMATCH": "Working Directory Invariant",
}


def category_counts(entries: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """Failures per category with the title of its rule, if it has one."""
    table = RULE_TITLES if titles is None else titles
    name = F.coalesce("category", F.lit(DEFAULT_CATEGORY))
    title = F.lit(None).cast("string")
    for key, text in table.items():
        title = F.when(F.col("category") == key, F.lit(text)).otherwise(title)
    return entries.groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("failures")).withColumn("rule_title", title)


def missing_programs(entries: DataFrame, category: str = MISSING_PROGRAM) -> DataFrame:
    """Distinct missing programs: named in the note, else the first word of the command."""
    note = F.coalesce(F.nullif("actionableFix", F.lit("")), "fix", F.lit(""))
    command = F.trim(F.coalesce(F.nullif("args.CommandLine", F.lit("")), "command", F.lit("")))
    named = F.regexp_extract(note, MISSING_NOTE, 1)
    program = F.when(named != "", named).otherwise(F.regexp_extract(command, r"^(\S+)", 1))
    return entries.filter(F.col("category") == category).select(program.alias("program")).filter("program <> ''").distinct()


def failure_streaks(events: DataFrame, keys: Sequence[str], order: str, row_id: str, failed: str, chunk: Column) -> DataFrame:
    """Consecutive failures up to each event (streak); a success resets to 0. ``no_success_yet`` marks the
    events before a session's first success, whose streak may go on from earlier data.

    ``chunk`` cuts a session into spans of bounded size by value (for example hours). Streaks are
    counted inside each span, the spans of a session are then chained through one summary row per
    span, and the carried count is added back. A session with a large share of all events is thus
    spread over its spans instead of being ordered by one task. The chunk must not decrease with
    the order column.
    """
    span = Window.partitionBy(*keys, "_chunk")
    ordered = span.orderBy(order, row_id)
    rows = events.withColumn("_chunk", chunk).withColumn("_ok", (~F.col(failed)).cast("int"))
    rows = rows.withColumn("_resets", F.sum("_ok").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(*keys, "_chunk", "_resets").orderBy(order, row_id)
    rows = rows.withColumn("_local", F.sum(F.col(failed).cast("int")).over(island.rowsBetween(Window.unboundedPreceding, 0)))
    # summary of a span: did it reset, and how many failures are open at its end
    ends = rows.groupBy(*keys, "_chunk").agg(
        F.max("_ok").alias("_reset"), F.max(F.struct("_resets", F.col("_local"))).alias("_end"))
    chain = Window.partitionBy(*keys).orderBy("_chunk")
    ends = ends.withColumn("_run", F.sum("_reset").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    open_run = Window.partitionBy(*keys, "_run").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_open", F.sum("_end._local").over(open_run))
    carry = ends.select(*keys, "_chunk", F.coalesce(F.lag("_open").over(chain), F.lit(0)).alias("_carry"),
                        F.coalesce(F.lag("_run").over(chain), F.lit(0)).alias("_run_before"))
    joined = rows.join(carry, [*keys, "_chunk"])
    streak = F.col("_local") + F.when(F.col("_resets") == 0, F.col("_carry")).otherwise(0)
    first = (F.col("_resets") == 0) & (F.col("_run_before") == 0)
    return joined.select(*events.columns, streak.cast("int").alias("streak"), first.alias("no_success_yet"))


def open_streaks(streaks: DataFrame, keys: Sequence[str], order: str, row_id: str) -> DataFrame:
    """Failures still open at the end of each session."""
    last = streaks.groupBy(*keys).agg(F.max(F.struct(order, row_id, "streak")).alias("_last"))
    return last.select(*keys, F.col("_last.streak").alias("open_failures"))


def continue_streaks(streaks: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add failures left open by earlier data to the events before each session's first success."""
    out = streaks.join(carried.select(*keys, "open_failures"), list(keys), "left")
    more = F.when(F.col("no_success_yet"), F.coalesce("open_failures", F.lit(0))).otherwise(0)
    return out.withColumn("streak", (F.col("streak") + more).cast("int")).select(*streaks.columns)


def with_breaker(streaks: DataFrame, at: int = BREAK_AT) -> DataFrame:
    return streaks.withColumn("deny_next", F.col("streak") >= at)
