"""Binary rubrics, model comparison, trace mining, ratings, funnels and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetric.functions.text import squeeze
from quillmetric.session import new_work_path

# Rating weights, decision bands and the bracket pattern of unfilled placeholders.
OPPORTUNITY_WEIGHTS = {"fit": 6, "access": 5, "interest": 4, "terms": 3, "timing": 2}
FIT_WEIGHTS = {"fit": 25, "portability": 20, "quality": 20, "safety": 20, "maintainability": 10, "docs": 5}
FIT_BANDS = ((85, "Adopt"), (70, "Adopt with edits"), (55, "Trial"), (40, "Fork / rewrite"))
BRACKETS = r"\[[A-Za-z0-9_\s]{2,}\]"


# ---- rubrics -----------------------------------------------------------------

def judge(outputs: DataFrame, assertions: DataFrame, output_id: str = "output_id", text: str = "text") -> DataFrame:
    """One row per output and assertion of its task: passed, and whether a rule decided it.

    ``assertions``: task_id, assertion_id, type, pattern, min_words, max_words, prompt, required.
    Assertions no rule can decide pass and are marked as not judged.
    """
    joined = outputs.join(assertions, "task_id")
    body, kind = F.col(text), F.lower(F.coalesce("type", F.lit("")))
    flat = squeeze(body)
    words = F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))
    in_range = (words >= F.coalesce("min_words", F.lit(0))) & (F.col("max_words").isNull() | (words <= F.col("max_words")))
    found = F.regexp_like(body, F.concat(F.lit("(?i)"), F.coalesce("pattern", F.lit(""))))
    wants_filled = F.contains(F.lower("assertion_id"), F.lit("placeholder")) | F.contains(
        F.lower(F.coalesce("prompt", F.lit(""))), F.lit("bracket"))
    passed = (F.when(kind == "word_count", in_range).when(kind == "regex_match", found).when(kind == "regex_disallow", ~found)
              .when(kind == "json_valid", F.try_parse_json(body).isNotNull())
              .when(wants_filled, ~body.rlike(BRACKETS)).otherwise(F.lit(True)))
    judged = kind.isin("word_count", "regex_match", "regex_disallow", "json_valid") | wants_filled
    return joined.select(output_id, "task_id", "assertion_id", F.coalesce("required", F.lit(True)).alias("required"),
                         passed.alias("passed"), judged.alias("judged"))


def rubric_summary(results: DataFrame, output_id: str = "output_id") -> DataFrame:
    """Pass rate per output; PASS only when every assertion passed."""
    rate = F.avg(F.when(F.col("passed"), 100.0).otherwise(0.0))
    return results.groupBy(output_id, "task_id").agg(
        F.count(F.lit(1)).alias("assertions"), F.count_if("passed").alias("passed"), rate.alias("pass_rate"),
        F.bool_or(F.col("required") & ~F.col("passed")).alias("required_failed"),
        F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("status"))


# ---- model comparison ----------------------------------------------------------

#: Cells per measure, and cells of the grid over all measures but one.
MOST_CELLS, GRID_CELLS = 32, 100_000


def _edges_passed(edges: Column, value: Column, high: bool) -> Column:
    return F.size(F.filter(edges, lambda edge: edge > value if high else edge < value))


def _cells(measures: Sequence[tuple[str, bool]], points: DataFrame) -> DataFrame:
    """The points with a cell number per measure, ``_c0`` and so on: a smaller number is a strictly better value."""
    others = max(1, len(measures) - 1)
    cells = max(2, min(MOST_CELLS, int(GRID_CELLS ** (1 / others))))
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    row = points.agg(*[F.percentile_approx(c, shares, 1000).alias(c) for c, _ in measures]).first()  # a few edges per measure
    for j, (c, high) in enumerate(measures):
        edges = F.array(*[F.lit(e) for e in sorted(set(row[c] or []))])
        points = points.withColumn(f"_c{j}", F.when(F.col(c).isNotNull(), _edges_passed(edges, F.col(c), high)))
    return points


def _beside_better_cells(points: DataFrame, n: int) -> DataFrame:
    """Points that have no point in a cell that is better on every measure; each step is a running minimum over a small grid."""
    *axes, last = [f"_c{j}" for j in range(n)]
    cells = points.select(*axes, last).distinct()
    if not axes:
        best = cells.agg(F.min(last).alias("_best"))
        return points.join(best, (F.col(last) <= F.col("_best")) | F.col(last).isNull(), "left_semi")
    size = cells.agg(F.max(F.greatest(F.lit(0), *axes))).first()[0] or 0
    grid = points.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(size))).alias(axes[0]))
    for axis in axes[1:]:
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(size))))
    grid = grid.join(cells.groupBy(*axes).agg(F.min(last).alias("_best")), axes, "left")
    for axis in axes:
        rest = [x for x in axes if x != axis]
        before = Window.partitionBy(*rest or [F.lit(0)]).orderBy(axis).rowsBetween(Window.unboundedPreceding, -1)
        grid = grid.withColumn("_best", F.min("_best").over(before))
    known = points.join(grid, axes, "left")
    return known.filter(F.col("_best").isNull() | F.col(last).isNull() | (F.col("_best") >= F.col(last))).drop("_best")


def pareto(models: DataFrame, better_high: Sequence[str], better_low: Sequence[str]) -> DataFrame:
    """Models no other model beats: at least as good on every measure and better on one. Values compare in their own types.

    Equal points are one point. A grid of quantile cells drops points with another point in a cell that is better on every
    measure. Any other point that beats a point shares a cell with it on some measure, so per measure an anti-join inside
    equal cells finds it; no step sees all points at once. Models with a null measure are neither beaten nor beat others.
    """
    measures = [(c, True) for c in better_high] + [(c, False) for c in better_low]
    names = [c for c, _ in measures]
    points = _cells(measures, models.select(*names).distinct())
    path = new_work_path(models.sparkSession, "frontier")
    _beside_better_cells(points, len(names)).write.parquet(path)
    left = models.sparkSession.read.schema(points.schema).parquet(path)
    rivals = left.select(*[F.col(c).alias(f"_r_{i}") for i, c in enumerate([*names, *[f"_c{j}" for j in range(len(names))]])])
    for j in range(len(names)):
        no_worse, better = F.lit(True), F.lit(False)
        for i, (c, high) in enumerate(measures):
            mine, theirs = F.col(c), F.col(f"_r_{i}")
            no_worse = no_worse & (theirs >= mine if high else theirs <= mine)
            better = better | (theirs > mine if high else theirs < mine)
        left = left.join(rivals, (F.col(f"_c{j}") == F.col(f"_r_{len(names) + j}")) & no_worse & better, "left_anti")
    same = F.lit(True)
    front = left.select(*[F.col(c).alias(f"_f_{i}") for i, c in enumerate(names)])
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"_f_{i}"))
    return models.join(front, same, "left_semi")


def tier_inversions(runs: DataFrame, scenario: str, tier: str, passed: str, frontier: str) -> DataFrame:
    """Scenarios a weaker tier passes and the frontier tier fails: a sign that the answer leaks."""
    ours = F.col(tier) == frontier
    seen = runs.groupBy(scenario).agg(
        F.bool_or(F.when(ours, F.col(passed))).alias("frontier_passed"), F.bool_or(F.when(~ours, F.col(passed))).alias("weaker_passed"))
    return seen.filter("weaker_passed AND NOT frontier_passed").select(scenario)


def regression_gate(base: DataFrame, new: DataFrame, task: str, passed: str, targets: Sequence[str] = ()) -> DataFrame:
    """One row: whether no task got worse and every target went from failing to passing. Missing tasks fail the gate."""
    rate = F.avg(F.col(passed).cast("double"))
    a = base.groupBy(task).agg(rate.alias("base_rate"))
    b = new.groupBy(task).agg(rate.alias("new_rate"))
    both = a.join(b, task, "full_outer")
    kept = F.coalesce(F.col("new_rate") >= F.col("base_rate"), F.col("base_rate").isNull())
    flipped = F.coalesce((F.col("base_rate") < 1) & (F.col("new_rate") >= 1), F.lit(False))
    wanted = F.col(task).isin(*targets) if targets else F.lit(False)
    return both.agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(~kept).alias("worse"),
        F.count_if(wanted & flipped).alias("targets_fixed"),
        (F.bool_and(kept) & (F.count_if(wanted & flipped) == len(targets))).alias("gate_passed"))


def mine_traces(traces: DataFrame, slow_ms: int) -> DataFrame:
    """Per tool: calls, invalid-argument share, retries, failed runs and slow runs.

    ``traces``: trace_id, failed, step_history array<struct<tool, error, ms>>. A retry is a call of the
    tool that just failed. Steps are numbered inside their own row, so no window is needed.
    """
    steps = F.transform("step_history", lambda s, i: F.struct(
        s["tool"].alias("tool"), s["ms"].alias("ms"), (s["error"] == "invalid_arguments").alias("invalid"),
        (F.get("step_history", i - 1)["tool"] == s["tool"]).alias("again"),
        F.get("step_history", i - 1)["error"].isNotNull().alias("after_error")))
    flat = traces.select("trace_id", "failed", F.explode(steps).alias("s")).select("trace_id", "failed", "s.*")
    per_run = flat.groupBy("trace_id", "tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("invalid").alias("invalid"),
        F.count_if(F.coalesce(F.col("again") & F.col("after_error"), F.lit(False))).alias("retries"),
        F.bool_or("failed").alias("failed"), F.bool_or(F.col("ms") > slow_ms).alias("slow"))
    return per_run.groupBy("tool").agg(
        F.sum("calls").alias("calls"), (F.sum("invalid") / F.sum("calls")).alias("invalid_rate"),
        F.sum("retries").alias("retries"), F.count_if("failed").alias("failed_runs"), F.count_if("slow").alias("slow_runs"))


# ---- ratings ----------------------------------------------------------------------

def opportunity_scores(df: DataFrame, ratings: str) -> DataFrame:
    """Weighted 20-100 score of five ratings; unknown ratings give bounds and a floor midpoint.

    ``ratings`` is array<string> of 1-5 or U. Rows with other values keep null scores and ``valid`` false.
    """
    value = F.col(ratings)
    weights = F.array(*[F.lit(w) for w in OPPORTUNITY_WEIGHTS.values()])
    names = F.array(*[F.lit(n) for n in OPPORTUNITY_WEIGHTS])
    valid = (F.size(value) == len(OPPORTUNITY_WEIGHTS)) & F.forall(value, lambda v: F.coalesce(v.rlike("^([1-5]|[uU])$"), F.lit(False)))

    def total(unknown: int) -> Column:
        parts = F.zip_with(value, weights, lambda v, w: F.when(F.upper(v) == "U", F.lit(unknown)).otherwise(v.try_cast("int")) * w)
        return F.when(valid, F.aggregate(parts, F.lit(0), lambda a, x: a + x))

    open_names = F.filter(F.zip_with(value, names, lambda v, n: F.when(F.upper(v) == "U", n)), lambda n: n.isNotNull())
    out = df.withColumns({"valid": valid, "minimum": total(1), "maximum": total(5),
                          "unknown": F.when(valid, F.array_join(open_names, ","))})
    return out.withColumn("kind", F.when(F.col("unknown") == "", "exact").when(F.col("valid"), "provisional")).withColumn(
        "midpoint", F.floor((F.col("minimum") + F.col("maximum")) / 2).cast("int"))


def fit_cards(df: DataFrame) -> DataFrame:
    """Weighted 0-100 score of six 1-5 ratings and its decision band."""
    total = F.lit(0.0)
    for name, weight in FIT_WEIGHTS.items():
        total = total + F.col(name) / F.lit(5.0) * weight
    out = df.withColumn("fit_score", F.bround(total, 9))
    band = F.lit("Reject")
    for floor, name in reversed(FIT_BANDS):
        band = F.when(F.col("fit_score") >= floor, name).otherwise(band)
    return out.withColumn("decision", band)


# ---- funnel and cost ------------------------------------------------------------------

def funnel(rows: DataFrame, stages: Sequence[str], segments: Sequence[str]) -> DataFrame:
    """Stage counts overall and by each segment on its own, with each stage's share of the one before.

    ``stages`` are boolean columns in funnel order; all groupings come from one pass.
    """
    grouped = rows.groupingSets([[]] + [[s] for s in segments], *segments).agg(
        *[F.count_if(s).alias(s) for s in stages], *[F.grouping(s).alias(f"_{s}") for s in segments])
    kind, value = F.lit("all"), F.lit("all")
    for s in segments:
        kind = F.when(F.col(f"_{s}") == 0, s).otherwise(kind)
        value = F.when(F.col(f"_{s}") == 0, F.coalesce(F.col(s).cast("string"), F.lit("(unknown)"))).otherwise(value)
    pieces = [F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("numerator"),
                       F.col(stages[i - 1] if i else s).alias("denominator")) for i, s in enumerate(stages)]
    flat = grouped.select(kind.alias("segment_kind"), value.alias("segment"), F.explode(F.array(*pieces)).alias("p"))
    return flat.select("segment_kind", "segment", "p.*").withColumn("rate", F.try_divide(F.col("numerator"), F.col("denominator")))


def cost_summary(log: DataFrame) -> DataFrame:
    """USD by model and engine as exact decimals with six places."""
    usd = F.col("usd").cast("decimal(18,6)")
    return log.groupBy("model", "engine").agg(F.coalesce(F.sum(usd), F.lit(0)).alias("usd"), F.count(F.lit(1)).alias("runs"))


def cost_total(log: DataFrame) -> DataFrame:
    """One row; 0 for an empty or missing log."""
    return log.agg(F.coalesce(F.sum(F.col("usd").cast("decimal(18,6)")), F.lit(0)).cast("decimal(28,6)").alias("total_usd"))
