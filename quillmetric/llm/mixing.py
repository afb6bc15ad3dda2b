"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Among all document rates between 0 and ``limit`` whose tokens meet every source's target, the rates nearest to 1 in
relative entropy are ``min(limit, exp(slope * size))``, with one slope per source that solves a convex problem. Newton
steps on the logarithm of the tokens, kept inside a shrinking bracket, find all slopes at once. Documents of one source
and size share a rate, so the steps run over counts of (source, size), which Spark gathers once. Rates become whole
copies per cell, and a few corrections of single copies take each source to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetric.llm.work import WORD, Workspace, running, small, text_or_empty

WEIGHTS = (1, 2, 3)
LIMIT = 3
STEPS = 60
TOLERANCE = 1e-7
CORRECTIONS = 6
CELL_BUCKETS = 4096

#: Sums are taken over whole millionths, so that their order cannot change a result.
_UNIT = 1e6


def _exact_sum(value: Column) -> Column:
    return F.sum(F.round(value * _UNIT).cast("decimal(32,0)")).cast("double") / _UNIT


def _sized() -> list[Column]:
    """``doc_id, src, no_src, size (words), tie``; rows that are equal in all this share a fate."""
    text, source, doc_id = text_or_empty(), F.col("source").cast("string"), F.col("doc_id").cast("long")
    return [doc_id.alias("doc_id"), F.coalesce(source, F.lit("")).alias("src"), source.isNull().alias("no_src"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(doc_id, text).alias("tie")]


def source_targets(cells: DataFrame, work: Workspace, limit: int = LIMIT) -> DataFrame:
    """``src, no_src, source_size, target``: the weights repeat over the sources in code point order, null last.

    All words are shared out by weight. A target stops at ``limit`` times its source; what is above is shared among the
    others by weight, again and again until no target is above.
    """
    totals = cells.groupBy("src", "no_src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running(totals, "one", ["no_src", "src"], "rank", work).drop("one")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighted = work.table(ranked.withColumn("weight", F.get(weights, (F.col("rank") % len(WEIGHTS)).cast("int"))), "sources")
    size, weight = F.col("source_size"), F.col("weight")
    level = None  # words per weight that open sources get
    while True:
        stops = F.lit(False) if level is None else weight * level > limit * size
        row = weighted.agg(F.sum(size).alias("all"), F.coalesce(F.sum(F.when(stops, limit * size)), F.lit(0)).alias("closed"),
                           F.sum(F.when(~stops, weight)).alias("open")).first()
        if not row["open"]:
            break
        new = (row["all"] - row["closed"]) / row["open"]
        if new == level:
            break
        level = new
    return weighted.withColumn("target", F.least((limit * size).cast("double"), weight * F.lit(float(level or 0.0)))).drop("rank", "weight")


def slopes(cells: DataFrame, targets: DataFrame, work: Workspace, limit: int = LIMIT) -> DataFrame:
    """``src, no_src, source_size, target, scale, slope``; the rate of a document is ``min(limit, exp(slope * size / scale))``.

    Every step is one pass over the cells; the small table of sources is written after each, so nothing piles up.
    """
    moments = cells.groupBy("src", "no_src").agg(
        F.try_divide(F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")),
                     F.sum(F.col("size").cast("double") * F.col("n"))).alias("scale"))
    share = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    state = (targets.join(moments, ["src", "no_src"])
             .withColumn("scale", F.round(F.coalesce("scale", F.lit(1.0)), 3))
             .withColumn("saturated", F.coalesce(share >= limit * (1 - 1e-12), F.lit(True)))
             .withColumn("low", F.least(F.lit(0.0), F.col("scale") * F.log(share)))
             .withColumn("high", F.when(share > 1, F.col("scale") * F.log(F.lit(float(limit)))).otherwise(0.0))
             .withColumn("slope", F.lit(0.0)).withColumn("off", F.lit(1.0)))
    state = work.table(state, "slopes")
    tilt = F.exp(F.col("slope") * F.col("size") / F.col("scale"))
    rate = F.least(F.lit(float(limit)), tilt)
    tokens = F.col("n") * F.col("size") * rate
    bend = F.when(tilt < limit, tokens * F.col("size") / F.col("scale")).otherwise(0.0)
    keep = [c for c in state.columns]
    for _ in range(STEPS):
        open_states = state.filter(~F.col("saturated") & (F.col("off") > TOLERANCE))
        if open_states.isEmpty():
            break
        sums = (cells.join(small(state), ["src", "no_src"]).groupBy("src", "no_src")
                .agg(_exact_sum(tokens).alias("reached"), _exact_sum(bend).alias("curve")))
        moved = state.filter("NOT saturated").join(sums, ["src", "no_src"])
        low = F.when(F.col("reached") < F.col("target"), F.col("slope")).otherwise(F.col("low"))
        high = F.when(F.col("reached") > F.col("target"), F.col("slope")).otherwise(F.col("high"))
        newton = F.col("slope") - F.try_divide(F.log(F.col("reached") / F.col("target")) * F.col("reached"), F.col("curve"))
        moved = moved.withColumn("low", low).withColumn("high", high).withColumn("newton", newton)
        inside = F.coalesce((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.lit(False))
        off = F.abs(F.col("reached") / F.col("target") - 1)
        step = F.when(off <= TOLERANCE, F.col("slope")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        moved = moved.withColumn("off", off).withColumn("slope", step)
        state = work.table(moved.select(*keep).unionByName(state.filter("saturated")), "slopes")
    return state.drop("low", "high", "off")


def copies_per_cell(cells: DataFrame, solved: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``src, no_src, size, n, source_size, target, copies``: whole copies of all n documents of a source and size.

    Expected copies are rounded up or down by a hash, without bias. Then single copies are added or taken away, largest
    first, as far as they do not overshoot; each round at least halves what a source is off. In the end a source is off by
    less than the size of its smallest document that could still be added or taken away.
    """
    rate = F.when(F.col("saturated"), F.lit(float(limit))).otherwise(
        F.least(F.lit(float(limit)), F.exp(F.col("slope") * F.col("size") / F.col("scale"))))
    chance = F.pmod(F.xxhash64("src", "size"), F.lit(1 << 20)) / float(1 << 20)
    rounded = F.floor(F.col("n") * rate + chance).cast("long")
    table = (cells.join(small(solved), ["src", "no_src"])
             .withColumn("copies", F.greatest(F.lit(0).cast("long"), F.least(F.col("n") * limit, rounded))))
    whole = Window.partitionBy("src", "no_src")
    ordered = whole.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("miss", F.round(F.col("target")).cast("long") - F.sum(F.col("copies") * F.col("size")).over(whole))
    for _ in range(CORRECTIONS):
        sign = F.signum(F.col("miss").cast("double")).cast("long")
        room = F.when(F.col("miss") > 0, F.col("copies") < F.col("n") * limit).otherwise(F.col("copies") > 0)
        fits = room & (F.col("size") > 0) & (F.col("size") <= F.abs("miss"))
        table = table.withColumn("fits", fits).withColumn(
            "filled", F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(ordered))
        table = table.withColumn("change", F.when(F.col("fits") & (F.col("filled") <= F.abs("miss")), sign).otherwise(0))
        table = table.withColumn("copies", F.col("copies") + F.col("change")).withColumn(
            "miss", F.col("miss") - F.sum(F.col("change") * F.col("size")).over(whole))
    # one last copy of the size that comes closest, if it brings the source nearer
    room = F.when(F.col("miss") > 0, F.col("copies") < F.col("n") * limit).otherwise(F.col("copies") > 0)
    rest = F.abs(F.col("size") - F.abs("miss"))
    closest = F.min(F.when(room & (F.col("size") > 0) & (rest < F.abs("miss")), F.struct(rest, F.col("size")))).over(whole)
    table = table.withColumn("closest", closest["size"])
    last = F.when(room & (F.col("size") == F.col("closest")), F.signum(F.col("miss").cast("double")).cast("long")).otherwise(0)
    table = table.withColumn("copies", F.col("copies") + last)
    return table.select("src", "no_src", "size", "n", "source_size", "target", "copies")


def _below_bucket(tie: str) -> Column:
    """The bits of a hash below those of its bucket, as a number that is never negative."""
    return F.shiftrightunsigned(F.shiftleft(tie, 12), 1)


def _extra_documents(sized: DataFrame, cells: DataFrame, work: Workspace) -> DataFrame:
    """Per cell whose copies do not divide evenly, the hash up to which documents get one copy more.

    The documents of a cell are dealt to buckets by the leading bits of their hash. Counts per bucket tell in which one the
    last extra copy falls; only that bucket is ordered, so a cell with a third of all documents is no task's burden.
    """
    key = ["src", "no_src", "size"]
    uneven = cells.filter(F.col("copies") % F.col("n") > 0).withColumn("extra", F.col("copies") % F.col("n"))
    uneven = small(work.table(uneven.select(*key, "extra"), "uneven"))
    bucket = F.shiftrightunsigned(F.col("tie"), 52)
    inside = work.table(sized.join(uneven, key).select(*key, "extra", "tie", bucket.alias("bucket")), "uneven-documents")
    counts = inside.groupBy(*key, "extra", "bucket").agg(F.count("*").alias("here"))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
    border = summed.filter((F.col("before") < F.col("extra")) & (F.col("before") + F.col("here") >= F.col("extra")))
    ranked = inside.join(border.select(*key, "bucket", "before"), [*key, "bucket"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy(*key).orderBy(_below_bucket("tie"), "tie")) + F.col("before"))
    # hashes compare as unsigned: by bucket, then by the bits below it
    last = ranked.filter(F.col("rank") == F.col("extra"))
    return last.select(*key, F.col("bucket").alias("last_bucket"), F.col("tie").alias("last_tie"))


def mix_plan(docs: DataFrame, work: Workspace, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Sized documents, and per (source, size) the copies that decide for each of them (see ``taken_copies``)."""
    sized = work.table(docs.select(*_sized()), "sizes")
    cells = work.table(sized.groupBy("src", "no_src", "size").agg(F.count("*").alias("n")), "cells")
    targets = work.table(source_targets(cells, work, limit), "targets")
    decided = work.table(copies_per_cell(cells, slopes(cells, targets, work, limit), limit), "copies")
    last = _extra_documents(sized, decided, work)
    plan = decided.join(last, ["src", "no_src", "size"], "left")
    return sized, small(work.table(plan, "plan"))


def taken_copies() -> Column:
    """Copies of a sized document that is joined with its cell of the plan."""
    low, last_low = _below_bucket("tie"), _below_bucket("last_tie")
    bucket = F.shiftrightunsigned(F.col("tie"), 52)
    more = (bucket < F.col("last_bucket")) | ((bucket == F.col("last_bucket")) & (low <= last_low))
    return F.floor(F.col("copies") / F.col("n")).cast("long") + F.coalesce(more, F.lit(False)).cast("long")


def mix(docs: DataFrame, work: Workspace, limit: int = LIMIT) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs(doc_id, text, source)``.

    ``taken``: words that the mix takes of the document, 0 to ``limit`` times its size, in whole copies. Null texts have
    size 0 and are never taken; a null source is a source of its own, after all others. Results depend on the rows alone,
    not on their order. An empty table gives no rows.
    """
    sized, plan = mix_plan(docs, work, limit)
    joined = sized.join(plan, ["src", "no_src", "size"]).withColumn("taken", taken_copies() * F.col("size"))
    return joined.select("doc_id", "size", "source_size", "target", "taken")


def repeat_documents(docs: DataFrame, work: Workspace, limit: int = LIMIT) -> DataFrame:
    """The documents as often as the mix takes them, their columns as they are. Documents without words do not appear."""
    _, plan = mix_plan(docs, work, limit)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_sized())
    copies = F.when(F.col("size") > 0, taken_copies()).otherwise(0).cast("int")
    joined = keyed.join(plan, ["src", "no_src", "size"])
    repeated = joined.select("_row", F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
