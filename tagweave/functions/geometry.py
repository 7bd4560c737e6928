"""Geometry as column expressions, and greedy folds over arrays of boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_pixel(x: Column, y: Column, matrix: Column, dpi: Column) -> tuple[Column, Column]:
    """A point of the page by its matrix struct(a, b, c, d, e, f), at dpi / 72 pixels a point."""
    m = lambda k: matrix[k]
    return (m("a") * x + m("c") * y + m("e")) * dpi / 72, (m("b") * x + m("d") * y + m("f")) * dpi / 72


def pixel_box(rect: Column, matrix: Column, dpi: Column) -> tuple[Column, Column]:
    """(bbox x, y, w, h; centre x, y) of a rectangle in pixels: corners in order, cut off towards zero."""
    ax, ay = to_pixel(rect["x0"], rect["y0"], matrix, dpi)
    bx, by = to_pixel(rect["x1"], rect["y1"], matrix, dpi)
    x0, x1, y0, y1 = F.least(ax, bx), F.greatest(ax, bx), F.least(ay, by), F.greatest(ay, by)
    whole = lambda v: v.cast("int")
    box = F.struct(whole(x0).alias("x"), whole(y0).alias("y"), whole(x1 - x0).alias("w"), whole(y1 - y0).alias("h"))
    return box, F.struct(whole((x0 + x1) / 2).alias("x"), whole((y0 + y1) / 2).alias("y"))


def label_crop(bbox: Column, width: Column, height: Column, margin: int = 40) -> Column:
    """Where a symbol's label is looked for: a margin at the sides, half of it above, twice below, within the image."""
    x0, y0 = F.greatest(F.lit(0), bbox["x"] - margin), F.greatest(F.lit(0), bbox["y"] - margin // 2)
    return F.struct(x0.alias("x0"), y0.alias("y0"), F.least(width, bbox["x"] + bbox["w"] + margin).alias("x1"), F.least(height, bbox["y"] + bbox["h"] + 2 * margin).alias("y1"))


def _overlap(a: tuple, b: tuple) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise((w * h).cast("double") / union)


def corners(box: Column) -> tuple:
    return box["x0"], box["y0"], box["x1"], box["y1"]


def sides(box: Column) -> tuple:
    return box["x"], box["y"], box["x"] + box["w"], box["y"] + box["h"]


def iou_corners(a: Column, b: Column) -> Column:
    """Intersection over union of structs x0, y0, x1, y1; 0 if they only touch."""
    return _overlap(corners(a), corners(b))


def iou_boxes(a: Column, b: Column) -> Column:
    """The same for structs x, y, w, h."""
    return _overlap(sides(a), sides(b))


def middle(box: Column) -> tuple[Column, Column]:
    return box["x"] + box["w"] / 2, box["y"] + box["h"] / 2


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def box_distance(x: Column, y: Column, w: Column, h: Column, px: Column, py: Column) -> Column:
    """From a point to a box; 0 within it."""
    dx = F.greatest(x - px, F.lit(0), px - (x + w))
    dy = F.greatest(y - py, F.lit(0), py - (y + h))
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def greedy(items: Column, clashes: Callable[[Column, Column], Column], kind: str) -> Column:
    """Of an array in order, each element that clashes with none kept before. kind: the array's SQL type."""
    return F.aggregate(items, F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: clashes(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
