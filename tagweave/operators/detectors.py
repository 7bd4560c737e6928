"""Symbols and pipe segments from vector drawings, and shapes from contour features.

All detectors read one ``drawings`` table; each is a filter over the same scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import pixel_box, to_pixel
from .spatial import coil_regions

BUBBLE_SIDES = ((14.0, 20.0),)
ASPECT = (0.7, 1.4)
VESSELS = (((60, 90), (80.0, 130.0), (15.0, 35.0)), ((40, 55), (8.0, 20.0), (50.0, 80.0)))
MIN_AREA, MAX_AREA_SHARE = 600.0, 0.2


def strokes(drawings: DataFrame) -> DataFrame:
    """Drawings that are stroked, with their width, height, longer and shorter side and number of items."""
    w, h = F.col("rect.x1") - F.col("rect.x0"), F.col("rect.y1") - F.col("rect.y0")
    seen = drawings.where(F.col("type").isin("s", "fs"))
    return seen.select("*", w.alias("wide"), h.alias("high"), F.greatest(w, h).alias("long"), F.least(w, h).alias("short"), F.size("items").alias("n"))


def _only(op: str) -> Column:
    """Whether all items are of one kind, where there are any."""
    return F.forall("items", lambda i: i["op"] == op)


def _solid() -> Column:
    return (F.col("wide") > 0) & (F.col("high") > 0)


def _squarish() -> Column:
    return _solid() & (F.col("wide") / F.nullif(F.col("high"), F.lit(0.0))).between(*ASPECT)


def closed_loop(items: Column) -> Column:
    """Whether all items are curves and the last ends where the first starts (within half a point)."""
    start = F.get(F.get(items, F.lit(0))["pts"], F.lit(0))
    end = F.try_element_at(F.try_element_at(items, F.lit(-1))["pts"], F.lit(-1))
    near = (F.abs(start["x"] - end["x"]) < 0.5) & (F.abs(start["y"] - end["y"]) < 0.5)
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda i: i["op"] == "c") & near, F.lit(False))


# Sides are tested before items, which are long and may have to be made first; of items the number once, then each.


def _count(*spans: tuple[int, int]) -> Column:
    return F.col("n").isin([k for low, high in spans for k in range(low, high + 1)])


def is_bubble() -> Column:
    size = F.lit(False)
    for low, high in BUBBLE_SIDES:
        size = size | F.col("long").between(low, high)
    return _squarish() & size & closed_loop(F.col("items"))


def is_bowtie() -> Column:
    return _squarish() & F.col("wide").between(9.0, 14.0) & F.col("high").between(9.0, 14.0) & _count((20, 30)) & _only("l")


def is_inline_valve() -> Column:
    return _solid() & F.col("long").between(15.0, 250.0) & F.col("short").between(5.0, 25.0) & _count((12, 12)) & _only("l")


def is_vessel() -> Column:
    out = F.lit(False)
    for n, wide, high in VESSELS:
        out = out | (F.col("wide").between(*wide) & F.col("high").between(*high) & _count(n) & _only("l"))
    return _solid() & out


def is_coil_arc() -> Column:
    return _solid() & F.col("short").between(1.5, 10.0) & F.col("long").between(1.5, 30.0) & _count((2, 2)) & _only("c")


def _shapes(drawings: DataFrame, pages: DataFrame, test: Column, kind: str) -> DataFrame:
    found = strokes(drawings).where(test).join(pages.select("page", "matrix", "dpi"), "page")
    bbox, center = pixel_box(F.col("rect"), F.col("matrix"), F.col("dpi"))
    return found.select("page", F.col("draw_id").alias("ord"), F.lit(kind).alias("kind"), bbox.alias("bbox"), center.alias("center"))


def circles(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    return _shapes(drawings, pages, is_bubble(), "circle")


def valves(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    return _shapes(drawings, pages, is_bowtie() | is_inline_valve(), "bowtie")


def vessels(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Sides are measured on the page as drawn, before it is turned."""
    return _shapes(drawings, pages, is_vessel(), "rectangle")


def segments(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Pipe runs: thin strokes of 8 points to half the page's shorter side, as their boxes' diagonals in pixels."""
    on = strokes(drawings).join(pages, "page")
    pipe = on.where((F.col("long") >= 8.0) & (F.col("long") <= 0.5 * F.least("width", "height")) & (F.col("short") <= 2.5))
    ends = [to_pixel(F.col(f"rect.x{k}"), F.col(f"rect.y{k}"), F.col("matrix"), F.col("dpi")) for k in (0, 1)]
    return pipe.select("page", F.col("draw_id").alias("seg_id"), *[v.alias(f"{n}{k}") for k, e in enumerate(ends, 1) for n, v in zip("xy", e)])


def coils(drawings: DataFrame) -> DataFrame:
    """Boxes round coils, in points: clusters of at least 8 small arcs."""
    arcs = strokes(drawings).where(is_coil_arc()).select("page", F.col("draw_id").alias("ord"), "rect.*")
    return coil_regions(arcs)


def contour_kinds(contours: DataFrame) -> DataFrame:
    """``contours`` with kind: by its children a pump, by its outline a rectangle, circle or bowtie, else unknown."""
    children = contours.where("parent >= 0").groupBy("page", F.col("parent").alias("idx")).agg(F.collect_list(F.struct("area", "vertices")).alias("children"))
    on = contours.join(children, ["page", "idx"], "left")
    area, n = F.col("area"), F.col("vertices")
    roundness = 4 * math.pi * area / (F.col("perimeter") * F.col("perimeter"))
    solidity = F.when(F.col("hull_area") > 0, area / F.col("hull_area")).otherwise(0.0)
    aspect = F.when(F.col("h") != 0, F.col("w") / F.col("h")).otherwise(0.0)
    share = lambda c: c["area"] / area
    pump = F.exists(F.coalesce("children", F.array().cast("array<struct<area: double, vertices: int>>")), lambda c: (c["area"] != 0) & (share(c) > 0.05) & (share(c) < 0.6) & c["vertices"].between(3, 4))
    kind = (
        F.when((area < MIN_AREA) | (F.col("perimeter") == 0), "unknown")
        .when(pump, "circle_triangle")
        .when((n == 4) & (solidity > 0.9) & (aspect > 0.5) & (aspect < 2.0), "rectangle")
        .when((n >= 6) & (roundness > 0.75) & (solidity > 0.85), "circle")
        .when((roundness < 0.7) & n.between(4, 8), "bowtie")
        .otherwise("unknown")
    )
    return on.withColumn("kind", kind).drop("children")


def contour_shapes(contours: DataFrame, pages: DataFrame) -> DataFrame:
    """Shapes of top-level contours of a known kind and an area of 600 pixels to a fifth of the page."""
    on = contour_kinds(contours).where("parent < 0 and kind <> 'unknown'").join(pages.select("page", (F.col("width") * F.col("height") * MAX_AREA_SHARE).alias("most")), "page")
    box = F.struct(*[F.col(c).cast("int").alias(c) for c in "xywh"])
    half = lambda a, s: (F.col(a) + F.floor(F.col(s) / 2)).cast("int")
    return on.where((F.col("area") >= MIN_AREA) & (F.col("area") <= F.col("most"))).select("page", F.col("idx").cast("bigint").alias("ord"), "kind", box.alias("bbox"), F.struct(half("x", "w").alias("x"), half("y", "h").alias("y")).alias("center"))
