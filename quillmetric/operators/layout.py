"""Page-layout tables: overlay copies, decoration images, primary button, large boxes.

Rectangles meet on grid cells: a box is listed in the cells it covers, a point in its own cell. The
viewport bounds the number of cells of a box.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetric.functions.numbers import contrast

# Overlap share, decoration and box shares of the viewport, contrast floor, fold bonus.
OVERLAP = 0.9
DECOR_SHARE, DECOR_TEXTS = 0.2, 3
BOX_SHARE = 0.012
MIN_CONTRAST, FOLD_BONUS = 1.6, 1.5
TEXT_KINDS = ("text", "heading", "button")
CELL = 256.0


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("int"), F.floor(F.greatest(low, high) / size).cast("int"))


def overlap_share(a: str, b: str) -> Column:
    """Shared area over the smaller area (at least 1)."""
    def side(start: str, length: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{start}") + F.col(f"{a}.{length}"), F.col(f"{b}.{start}") + F.col(f"{b}.{length}"))
                          - F.greatest(F.col(f"{a}.{start}"), F.col(f"{b}.{start}")))

    smaller = F.least(F.col(f"{a}.w") * F.col(f"{a}.h"), F.col(f"{b}.w") * F.col(f"{b}.h"))
    return side("x", "w") * side("y", "h") / F.greatest(F.lit(1.0), smaller)


def drop_overlays(nodes: DataFrame, snapshot: str = "snapshot", idx: str = "idx", cell: float = CELL) -> DataFrame:
    """Drop a node when an earlier one of the same kind and text overlaps at least 90 % of the smaller of the two.

    Exact copies fold to their first one by aggregation. For the rest, the smaller box of such a pair
    has its centre inside the larger one, so centres meet larger boxes on grid cells.
    """
    group = [snapshot, "kind", F.coalesce("text", F.lit("")).alias("_text")]
    boxes = nodes.select(idx, *group, "x", "y", "w", "h")
    area = F.col("w") * F.col("h")
    shape = [snapshot, "kind", "_text", "x", "y", "w", "h"]
    first = boxes.groupBy(*shape).agg(F.min(idx).alias(idx))
    copies = boxes.join(first.withColumnRenamed(idx, "_first"), shape).filter(
        (F.col(idx) > F.col("_first")) & (area / F.greatest(F.lit(1.0), area) >= OVERLAP)).select(snapshot, idx)
    keys = [snapshot, "kind", "_text", "_cx", "_cy"]
    points = first.withColumn("_cx", F.floor((F.col("x") + F.col("w") / 2) / cell).cast("int")).withColumn(
        "_cy", F.floor((F.col("y") + F.col("h") / 2) / cell).cast("int"))
    covers = first.withColumn("_cx", F.explode(_cells(F.col("x"), F.col("x") + F.col("w"), cell))).withColumn(
        "_cy", F.explode(_cells(F.col("y"), F.col("y") + F.col("h"), cell)))
    small, large = points.alias("s"), covers.alias("l")
    size = lambda t: F.col(f"{t}.w") * F.col(f"{t}.h")
    met = small.join(large, keys).filter(
        (F.col(f"s.{idx}") != F.col(f"l.{idx}")) & (size("s") <= size("l")) & (overlap_share("s", "l") >= OVERLAP))
    later = met.select(snapshot, F.greatest(F.col(f"s.{idx}"), F.col(f"l.{idx}")).alias(idx))
    # copies of a dropped box are dropped with it or by their own first one, so both sets together are complete
    dropped_first = later.distinct()
    return nodes.join(copies.unionByName(dropped_first).distinct(), [snapshot, idx], "left_anti")


def drop_decoration(nodes: DataFrame, width: float, height: float, max_y: float | None = None,
                    snapshot: str = "snapshot", idx: str = "idx", cell: float = CELL) -> DataFrame:
    """Drop images that cover a fifth of the viewport and have three or more texts centred on them."""
    bottom = height if max_y is None else max_y
    shown = F.col("w") * F.least(F.col("h"), F.lit(bottom) - F.col("y"))
    images = nodes.filter((F.col("kind") == "image") & (shown >= width * height * DECOR_SHARE)).select(snapshot, idx, "x", "y", "w", "h")
    covers = images.withColumn("_cx", F.explode(_cells(F.col("x"), F.col("x") + F.col("w"), cell))).withColumn(
        "_cy", F.explode(_cells(F.col("y"), F.col("y") + F.col("h"), cell)))
    centre_x, centre_y = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    texts = nodes.filter(F.col("kind").isin(*TEXT_KINDS)).select(
        snapshot, centre_x.alias("px"), centre_y.alias("py")).withColumn(
        "_cx", F.floor(F.col("px") / cell).cast("int")).withColumn("_cy", F.floor(F.col("py") / cell).cast("int"))
    # texts at one spot count together before they meet the images
    texts = texts.groupBy(snapshot, "_cx", "_cy", "px", "py").agg(F.count(F.lit(1)).alias("n"))
    inside = covers.join(texts, [snapshot, "_cx", "_cy"]).filter(
        (F.col("px") > F.col("x")) & (F.col("px") < F.col("x") + F.col("w"))
        & (F.col("py") > F.col("y")) & (F.col("py") < F.col("y") + F.col("h")))
    decor = inside.groupBy(snapshot, idx).agg(F.sum("n").alias("n")).filter(F.col("n") >= DECOR_TEXTS)
    return nodes.join(decor.select(snapshot, idx), [snapshot, idx], "left_anti")


def primary_buttons(nodes: DataFrame, height: float, snapshot: str = "snapshot", idx: str = "idx",
                    columns: Sequence[str] = ()) -> DataFrame:
    """Per page the filled button with the highest contrast x root of area, half as much again above the fold."""
    ratio = contrast(F.col("bg"), F.col("page_bg"))
    score = ratio * F.sqrt(F.col("w") * F.col("h")) * F.when(F.col("y") < height, FOLD_BONUS).otherwise(1.0)
    scored = nodes.filter((F.col("kind") == "button") & F.col("filled")).withColumn("_c", ratio).filter(
        F.col("_c") >= MIN_CONTRAST).withColumn("button_score", score).filter("button_score > 0")
    best = scored.groupBy(snapshot).agg(F.max(F.struct("button_score", (-F.col(idx)).alias("_first"), idx, *columns)).alias("b"))
    return best.select(snapshot, F.col(f"b.{idx}").alias(idx), "b.button_score", *[f"b.{c}" for c in columns])


def large_boxes(nodes: DataFrame, width: float, height: float, snapshot: str = "snapshot") -> DataFrame:
    """Boxes of at least 1.2 % of the viewport, largest first."""
    area = F.col("w") * F.col("h")
    return nodes.filter((F.col("kind") == "box") & (area >= width * height * BOX_SHARE)).withColumn("area", area).orderBy(
        snapshot, F.desc("area"), "y")
