"""Spatial operators: nearest joins over a grid, suppression, tiles, clusters.

Boxes and points meet by grid cell, an equi-join that spreads over the cluster, before the exact predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.geometry import box_distance, distance, greedy, iou_corners, middle
from ..functions.vocabulary import EQUIPMENT_PREFIXES

CELL = 64
#: Boxes upon a point at which looking for one that holds it starts, and cells (of points) that may be broadcast.
LAYERS, FEW_CELLS = 3.0, 200_000
ENDPOINT_REACH = 20.0
MERGE_IOU = 0.5
TILE, TILE_OVERLAP = 640, 96
LABEL_RADIUS = 60.0
LABEL_HALF = 220
EQUIPMENT_MARGIN = 150
SEARCH_HALF = 300
ARC_GAP, MIN_ARCS = 6.0, 8


def _cells(lo: Column, hi: Column, size: int) -> Column:
    first, last = F.floor(lo / size), F.floor(hi / size)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _spread(boxes: DataFrame, reach: float, cell: int) -> DataFrame:
    """boxes(page, x, y, w, h, ...) once for each cell that they, widened by ``reach``, touch."""
    out = boxes.withColumn("cx", F.explode(_cells(F.col("x") - reach, F.col("x") + F.col("w") + reach, cell)))
    return out.withColumn("cy", F.explode(_cells(F.col("y") - reach, F.col("y") + F.col("h") + reach, cell)))


def grid_pairs(points: DataFrame, boxes: DataFrame, reach: float, cell: int = CELL) -> DataFrame:
    """points(page, px, py, ...) with the boxes(page, x, y, w, h, ...) that are within about ``reach``."""
    spread = _spread(boxes, reach, cell)
    placed = points.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    return placed.join(spread, ["page", "cx", "cy"]).drop("cx", "cy")


def _near_cells(boxes: DataFrame, points: DataFrame, reach: float, cell: int) -> DataFrame:
    """``boxes`` spread over the cells of ``points`` (a checkpoint) only, where those are few."""
    spread = _spread(boxes, reach, cell)
    cells = points.select("page", F.floor(F.col("px") / cell).alias("cx"), F.floor(F.col("py") / cell).alias("cy")).distinct()
    few = cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    return spread.join(F.broadcast(cells), ["page", "cx", "cy"], "left_semi") if few else spread


def _holders(points: DataFrame, boxes: DataFrame, cell: int) -> tuple[list[DataFrame], DataFrame]:
    """([(page, point, ord)], rest): for each place of a point the least ord of the boxes that hold it, and places that none does.

    Boxes are taken in order of ord, first as many as hold a point a few times, then eight times as many, and so on:
    what a point meets in the first boxes is its least, so only the others go on. Pairs grow with the points then,
    however many boxes lie upon each other.
    """
    from ..plans.session import cut

    pages = boxes.groupBy("page").agg(F.sum(F.col("w").cast("double") * F.col("h")).alias("area"), ((F.max(F.expr("x + w")) - F.min("x")).cast("double") * (F.max(F.expr("y + h")) - F.min("y"))).alias("page_area"))
    deep = pages.agg(F.try_divide(F.sum("area"), F.sum("page_area"))).first()[0] or 0.0
    shares = []
    while deep > LAYERS:
        shares.append(LAYERS / deep)
        deep /= 8
    ends = boxes.agg(F.percentile_approx("ord", F.array(*map(F.lit, shares)), 100_000)).first()[0] or [] if shares else []
    found, last = [], None
    for end in [*sorted(set(ends)), None]:
        part = boxes if last is None else boxes.where(F.col("ord") > last)
        part, last = part if end is None else part.where(F.col("ord") <= end), end
        spread = _near_cells(part, points, 0, cell) if found else _spread(part, 0, cell)
        placed = points.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
        holds = F.expr("case when px between x and x + w and py between y and y + h then ord end")
        tried = cut(placed.join(spread, ["page", "cx", "cy"], "left").groupBy("page", "point", "px", "py").agg(F.min(holds).alias("ord")))
        found.append(tried.where("ord is not null").select("page", "point", "ord"))
        points = tried.where("ord is null").select("page", "point", "px", "py")
    return found, points


def nearest_box(points: DataFrame, boxes: DataFrame, reach: float = ENDPOINT_REACH, cell: int = CELL) -> DataFrame:
    """(page, point, ord, dist): for each points(page, point, px, py) the nearest of boxes(page, ord, x, y, w, h).

    Only boxes nearer than ``reach``; of equally near ones the first by ord. Points without any are left out.
    """
    from ..plans.session import cut

    points, boxes = points.select("page", "point", "px", "py"), cut(boxes.select("page", "ord", "x", "y", "w", "h"))
    # boxes round a point are the nearest of all; only points outside of all boxes are looked for within reach
    inside, outside = _holders(points, boxes, cell)
    dist = box_distance(*[F.col(c) for c in ("x", "y", "w", "h", "px", "py")])
    placed = outside.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    near = placed.join(_near_cells(boxes, outside, reach, cell), ["page", "cx", "cy"]).select("page", "point", "ord", dist.alias("dist")).where(F.col("dist") < reach)
    for part in inside:
        near = near.unionByName(part.withColumn("dist", F.lit(0.0)))
    # a point that comes at several places has the nearest of all of them
    return near.groupBy("page", "point").agg(F.min(F.struct("dist", "ord")).alias("n")).select("page", "point", "n.ord", "n.dist")


def segment_edges(segments: DataFrame, boxes: DataFrame, reach: float = ENDPOINT_REACH, cell: int = CELL) -> DataFrame:
    """Distinct (page, a, b), a < b: boxes (by ord) that a segment joins, each end lying nearest to one of them."""
    ends = segments.select("page", F.inline(F.array(*[F.struct(F.struct(F.col("seg_id"), F.lit(k).alias("end")).alias("point"), F.col(f"x{k}").alias("px"), F.col(f"y{k}").alias("py")) for k in (1, 2)])))
    hits = nearest_box(ends, boxes, reach, cell)
    pairs = hits.groupBy("page", F.col("point.seg_id").alias("seg_id")).agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.count("*").alias("n"))
    return pairs.where("n = 2 and a <> b").select("page", "a", "b").distinct()


def suppress_overlaps(detections: DataFrame, threshold: float = MERGE_IOU, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Detections that overlap no surer one that stays, by more than ``threshold``; of equally sure ones the first."""
    item = F.struct((-F.col("confidence")).alias("minus"), "ord", "xyxy", "class_name", "confidence")
    kind = "array<struct<minus: double, ord: bigint, xyxy: struct<x0: int, y0: int, x1: int, y1: int>, class_name: string, confidence: double>>"
    per = detections.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("all"))
    kept = greedy(F.col("all").cast(kind), lambda k, x: iou_corners(k["xyxy"], x["xyxy"]) > threshold, kind)
    return per.select(*keys, F.inline(kept)).select(*keys, "ord", "xyxy", "class_name", "confidence")


def tile_offsets(pages: DataFrame, tile: int = TILE, overlap: int = TILE_OVERLAP) -> DataFrame:
    """``pages`` (width, height) with one row for each tile: tile_no (row by row), tile_x, tile_y."""

    def along(size: Column) -> Column:
        step = tile - overlap
        at = F.sequence(F.lit(0), F.greatest(size - tile, F.lit(0)), F.lit(step))
        rest = F.element_at(at, -1) + tile < size
        return F.when(rest, F.concat(at, F.array(size - tile))).otherwise(at)

    width, height = F.col("width").cast("int"), F.col("height").cast("int")
    tiles = F.flatten(F.transform(along(height), lambda y: F.transform(along(width), lambda x: F.struct(x.alias("tile_x"), y.alias("tile_y")))))
    out = pages.select("*", F.posexplode(tiles).alias("tile_no", "t"))
    return out.select(*[c for c in out.columns if c != "t"], "t.*")


def detected_shapes(detections: DataFrame, pages: DataFrame, confidence: float = 0.25, tile: int = TILE) -> DataFrame:
    """Shapes (page, ord, kind, bbox, center) of raw detections (.., tile_x, tile_y) of pages(page, width, height).

    Boxes are moved from their tile to the page. On pages of more than one tile overlaps are suppressed.
    """
    moved = F.struct(*[(F.col(f"xyxy.{c}") + F.col(f"tile_{c[0]}")).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
    sure = detections.where(F.col("confidence") >= confidence).select("page", F.col("ord").cast("bigint").alias("ord"), moved.alias("xyxy"), "class_name", "confidence")
    sized = sure.join(pages.select("page", ((F.col("width") > tile) | (F.col("height") > tile)).alias("tiled")), "page")
    cols = ["page", "ord", "xyxy", "class_name", "confidence"]
    kept = suppress_overlaps(sized.where("tiled")).select(*cols).unionByName(sized.where("not tiled").select(*cols))
    x = F.col("xyxy")
    box = F.struct(x["x0"].alias("x"), x["y0"].alias("y"), (x["x1"] - x["x0"]).alias("w"), (x["y1"] - x["y0"]).alias("h"))
    half = lambda a, b: F.floor((x[a] + x[b]) / 2).cast("int")
    return kept.select("page", "ord", S.class_kind(F.col("class_name")).alias("kind"), box.alias("bbox"), F.struct(half("x0", "x1").alias("x"), half("y0", "y1").alias("y")).alias("center"), "class_name", "confidence")


def not_near(points: DataFrame, boxes: DataFrame, margin: int = EQUIPMENT_MARGIN, cell: int = 256) -> DataFrame:
    """points(page, point, px, py, ...) that lie in no box widened by ``margin`` (its border is in it)."""
    near = grid_pairs(points.select("page", "point", "px", "py"), boxes.select("page", "x", "y", "w", "h"), margin, cell)
    x, y = F.col("px"), F.col("py")
    inside = x.between(F.col("x") - margin, F.col("x") + F.col("w") + margin) & y.between(F.col("y") - margin, F.col("y") + F.col("h") + margin)
    return points.join(near.where(inside).select("page", "point").distinct(), ["page", "point"], "left_anti")


def spaced_labels(points: DataFrame, radius: float = LABEL_RADIUS) -> DataFrame:
    """(page, ord, cx, cy): points in order of ord, without those nearer than ``radius`` to one that stays."""
    kind = "array<struct<ord: bigint, cx: double, cy: double>>"
    per = points.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(F.col("ord").cast("bigint").alias("ord"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy")))).alias("all"))
    kept = greedy(F.col("all"), lambda k, x: distance(k["cx"], k["cy"], x["cx"], x["cy"]) < radius, kind)
    return per.select("page", F.inline(kept))


def _label_words(words: DataFrame) -> DataFrame:
    return words.withColumn("word", F.upper(S.stripped(F.col("text")))).where("word <> ''").withColumns({"cx": F.col("left") + F.col("width") / 2, "cy": F.col("top") + F.col("height") / 2})


def label_candidates(words: DataFrame, equipment: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions (page, ord, kind, bbox, center) round words that read like equipment tags.

    Not those near equipment(page, x, y, w, h) that is known, nor repeats of a place (which count even if their
    region turns out empty). Regions end at the page's border.
    """
    hit = S.first_match(F.col("word"), S.TOLERANT_TAG)
    found = _label_words(words).where(hit.isin(EQUIPMENT_PREFIXES))
    found = found.select("page", F.col("ord").alias("point"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    free = not_near(found, equipment).select("page", F.col("point").alias("ord"), F.col("px").alias("cx"), F.col("py").alias("cy"))
    kept = spaced_labels(free).join(pages.select("page", "width", "height"), "page")
    low = lambda c: F.greatest(F.lit(0), (F.col(c) - LABEL_HALF).cast("int"))
    high = lambda c, most: F.least(F.col(most).cast("int"), (F.col(c) + LABEL_HALF).cast("int"))
    box = kept.select("page", "ord", "cx", "cy", low("cx").alias("x0"), low("cy").alias("y0"), high("cx", "width").alias("x1"), high("cy", "height").alias("y1")).where("x1 > x0 and y1 > y0")
    bbox = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.expr("x1 - x0").alias("w"), F.expr("y1 - y0").alias("h"))
    return box.select("page", "ord", F.lit("equipment_label_region").alias("kind"), bbox.alias("bbox"), F.struct(F.col("cx").cast("int").alias("x"), F.col("cy").cast("int").alias("y")).alias("center"))


def known_equipment_tags(shapes: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, ord, tag): for each shape(page, ord, bbox) the nearest equipment tag among the words round it.

    Words count if they lie wholly in the square of twice ``SEARCH_HALF`` round the shape's centre, cut off at the
    page's border; of equally near ones the first.
    """
    text = S.plain_separators(F.col("word"))
    tags = _label_words(words).withColumn("tag", S.first_match(text, S.BOUND_TAG)).where(F.get(F.split("tag", "-"), F.lit(0)).isin(EQUIPMENT_PREFIXES))
    sx, sy = middle(F.col("bbox"))
    placed = shapes.select("page", F.col("ord").alias("shape"), sx.alias("sx"), sy.alias("sy")).join(pages.select("page", F.col("width").alias("pw"), F.col("height").alias("ph")), "page")
    edge = {"x0": F.greatest(F.lit(0), (F.col("sx") - SEARCH_HALF).cast("int")), "y0": F.greatest(F.lit(0), (F.col("sy") - SEARCH_HALF).cast("int")), "x1": F.least(F.col("pw").cast("int"), (F.col("sx") + SEARCH_HALF).cast("int")), "y1": F.least(F.col("ph").cast("int"), (F.col("sy") + SEARCH_HALF).cast("int"))}
    area = placed.withColumns(edge).select("page", "shape", "sx", "sy", F.col("x0").alias("x"), F.col("y0").alias("y"), F.expr("x1 - x0").alias("w"), F.expr("y1 - y0").alias("h"))
    near = grid_pairs(tags.select("page", F.col("ord").alias("word_ord"), "tag", F.col("cx").alias("px"), F.col("cy").alias("py"), "left", "top", "width", "height"), area, 0, 256)
    inside = F.expr("left >= x and top >= y and left + width <= x + w and top + height <= y + h")
    best = near.where(inside).groupBy("page", "shape").agg(F.min_by("tag", F.struct(distance(F.col("px"), F.col("py"), F.col("sx"), F.col("sy")), F.col("word_ord"))).alias("tag"))
    return best.select("page", F.col("shape").alias("ord"), "tag")


def _lattice(boxes: DataFrame, gap: float) -> DataFrame:
    """boxes(page, ord, x0, y0, x1, y1) with r, t, their right and top moved by ``gap``, and cells a..c across and b..d up.

    Two boxes are near if the rectangles x0..r, y0..t meet. Cells are smaller than any rectangle, so that each crosses
    from one cell to the next both ways: it holds the crossings (i, j) of a < i <= c, b < j <= d.
    """
    from ..plans.session import cut

    box = boxes.select("page", "ord", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    box = cut(box.where("page is not null and x1 >= x0 and y1 >= y0")).withColumns({"r": F.col("x1") + gap, "t": F.col("y1") + gap})
    least = box.agg(F.min(F.least(F.expr("r - x0"), F.expr("t - y0")))).first()[0]
    size = 0.99 * (least or 1.0)
    return box.withColumns({n: F.floor(F.col(c) / size) for n, c in zip("abcd", ("x0", "y0", "r", "t"))})


def _corner_links(box: DataFrame) -> DataFrame:
    """(page, i, j, up): cells in which the far corner of one rectangle passes the near corner of another.

    They link crossing (i, j) with (i + 1, j + 1), or, where ``up`` is false, (i, j + 1) with (i + 1, j): of rectangles
    that meet only within a cell.
    """
    corner = lambda i, j, x, y, up, far: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(up).alias("up"), F.lit(far).alias("far"))
    # where a box passes another downwards, heights count from above
    down = box.withColumns({"y0": -F.col("y0"), "t": -F.col("t")})
    upward = box.select("page", F.inline(F.array(corner("c", "d", "r", "t", True, True), corner("a", "b", "x0", "y0", True, False))))
    downward = down.select("page", F.inline(F.array(corner("c", "b", "r", "y0", False, True), corner("a", "d", "x0", "t", False, False))))
    # at one x only the furthest of the far corners and the nearest of the near ones count
    per = upward.unionByName(downward).groupBy("page", "i", "j", "up", "x").agg(F.max(F.when(F.col("far"), F.col("y"))).alias("reach"), F.min(F.when(~F.col("far"), F.col("y"))).alias("start"))
    right = Window.partitionBy("page", "i", "j", "up").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("reach", F.max("reach").over(right)).where("reach >= start").select("page", "i", "j", "up").distinct()


def _crossings(box: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((page, i, j, run), (page, u, v)): crossings that rectangles hold, in runs along a row, and links between runs.

    Rectangles that hold one crossing meet. Neighbours are linked if the one's furthest rectangle reaches the other's
    nearest; a rectangle's own crossings are. All other meetings are corner links.
    """
    from ..plans.session import cut

    held = box.withColumn("i", F.explode(F.sequence(F.col("a") + 1, F.col("c")))).withColumn("j", F.explode(F.sequence(F.col("b") + 1, F.col("d"))))
    held = held.groupBy("page", "i", "j").agg(F.min("x0").alias("x0"), F.max("r").alias("r"), F.min("y0").alias("y0"), F.max("t").alias("t"))
    row = Window.partitionBy("page", "j").orderBy("i")
    goes_on = (F.lag("i").over(row) == F.col("i") - 1) & (F.lag("r").over(row) >= F.col("x0"))
    starts = held.withColumn("start", F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("i")))
    runs = starts.withColumn("run", F.struct("j", F.last("start", True).over(row).alias("i")))
    runs = cut(runs.select("page", "i", "j", "y0", "t", "run"))
    lower = runs.select("page", "i", (F.col("j") + 1).alias("j"), F.col("run").alias("u"), F.col("t").alias("below"))
    above = lower.join(runs, ["page", "i", "j"]).where("below >= y0").select("page", "u", F.col("run").alias("v"))
    cells = _corner_links(box)
    end = lambda name, di, dj: runs.select("page", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("run").alias(name))
    at = ["page", "i", "j"]
    rising = cells.where("up").join(end("u", 0, 0), at).join(end("v", 1, 1), at)
    falling = cells.where("not up").join(end("u", 0, 1), at).join(end("v", 1, 0), at)
    links = above.unionByName(rising.select("page", "u", "v")).unionByName(falling.select("page", "u", "v"))
    return runs.select("page", "i", "j", "run"), links.where("u <> v").distinct()


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(page, node, root) of nodes(page, node) joined by edges(page, u, v).

    Labels spread by hooking each root to the least root next to it and jumping, so that rounds grow with the
    logarithm of a component's length. Each round is a table in the shared folder, deleted after the next: a checkpoint
    keeps the estimated size of its joins, a number that grows to so many digits that planning doesn't end.
    """
    from ..plans.session import delete, written

    edges, label = written(edges), written(nodes.select("page", "node", F.col("node").alias("root")))
    while True:
        side = lambda node, root: label.select("page", F.col("node").alias(node), F.col("root").alias(root))  # noqa: E731, B023
        ends = edges.join(side("u", "ru"), ["page", "u"]).join(side("v", "rv"), ["page", "v"]).where("ru <> rv")
        hook = written(ends.groupBy("page", F.greatest("ru", "rv").alias("root")).agg(F.min(F.least("ru", "rv")).alias("to")))
        if hook.isEmpty():
            delete(edges)
            delete(hook)
            return label
        moved = label.join(hook, ["page", "root"], "left").select("page", "node", F.coalesce("to", "root").alias("root"))
        up = moved.select("page", F.col("node").alias("root"), F.col("root").alias("top"))
        last, label = label, written(moved.join(up, ["page", "root"]).select("page", "node", F.col("top").alias("root")))
        delete(last)
        delete(hook)


def _linked(arcs: DataFrame, gap: float) -> tuple[DataFrame, DataFrame]:
    """(boxes on the lattice, (page, i, j, cluster)): the cluster of each crossing; near boxes are never paired."""
    box = _lattice(arcs, gap)
    runs, links = _crossings(box)
    labels = _components(runs.select("page", F.col("run").alias("node")).distinct(), links)
    return box, runs.join(labels.withColumnRenamed("node", "run"), ["page", "run"]).select("page", "i", "j", F.col("root").alias("cluster"))


def clusters(boxes: DataFrame, gap: float = ARC_GAP) -> DataFrame:
    """(page, ord, root) of boxes(page, ord, x0, y0, x1, y1): single-linkage clusters over gaps of at most ``gap``.

    root is the least ord. A box without a page, or whose sides are missing or turned, is near none.
    """
    box, found = _linked(boxes, gap)
    mine = box.select("page", "ord", (F.col("a") + 1).alias("i"), (F.col("b") + 1).alias("j")).join(found, ["page", "i", "j"])
    least = mine.groupBy("page", "cluster").agg(F.min("ord").alias("root"))
    rest = boxes.where("page is null or not coalesce(x1 >= x0 and y1 >= y0, false)").select("page", "ord", F.col("ord").alias("root"))
    return mine.join(least, ["page", "cluster"]).select("page", "ord", "root").unionByName(rest)


def coil_regions(arcs: DataFrame, gap: float = ARC_GAP, least: int = MIN_ARCS) -> DataFrame:
    """(page, root, arcs, x0, y0, x1, y1): boxes round clusters of at least ``least`` arcs."""
    box, found = _linked(arcs, gap)
    whole = lambda n, ord_: [n.alias("arcs"), F.min(ord_).alias("root"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    mine = box.groupBy("page", (F.col("a") + 1).alias("i"), (F.col("b") + 1).alias("j")).agg(*whole(F.count("*"), "ord"))
    out = mine.join(found, ["page", "i", "j"]).groupBy("page", "cluster").agg(*whole(F.sum("arcs"), "root"))
    return out.where(F.col("arcs") >= least).select("page", "root", "arcs", "x0", "y0", "x1", "y1")
