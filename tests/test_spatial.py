import math
import random

import pytest
from pyspark.sql import functions as F

from tagweave.functions.geometry import iou_boxes, iou_corners, label_crop
from tagweave.operators import spatial as G


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def test_iou(spark):
    rows = [((0, 0, 10, 10), (0, 0, 10, 10)), ((0, 0, 10, 10), (10, 0, 20, 10)), ((0, 0, 10, 10), (5, 5, 15, 15)), ((0, 0, 0, 0), (0, 0, 0, 0)), ((0, 0, 10, 10), (2, 2, 4, 4))]
    s = "struct<x0 int, y0 int, x1 int, y1 int>"
    df = spark.createDataFrame(rows, f"a {s}, b {s}")
    assert [r.v for r in df.select(iou_corners(F.col("a"), F.col("b")).alias("v")).collect()] == [pytest.approx(iou(a, b)) for a, b in rows]
    t = "struct<x double, y double, w double, h double>"
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 10.0, 10.0))], f"a {t}, b {t}")
    assert df.select(iou_boxes(F.col("a"), F.col("b"))).first()[0] == pytest.approx(25 / 175)


def test_label_crop(spark):
    df = spark.createDataFrame([((10, 5, 30, 30),)], "b struct<x int, y int, w int, h int>")
    assert tuple(df.select(label_crop(F.col("b"), F.lit(75), F.lit(300)).alias("c")).first().c) == (0, 0, 75, 115)


@pytest.mark.parametrize("cell", [8, 64, 1000])
def test_nearest_against_all_pairs(spark, cell):
    rng = random.Random(cell)
    boxes = [(p, o, rng.randrange(-50, 400), rng.randrange(400), rng.randrange(1, 60), rng.randrange(1, 60)) for p in range(2) for o in range(60)] + [(0, 100, 500, 500, 10, 10), (0, 99, 500, 500, 10, 10)]
    points = [(p, k, rng.uniform(-60, 460), rng.uniform(-20, 460)) for p in range(2) for k in range(150)] + [(0, 900, 505.0, 505.0), (0, 901, 490.0, 505.0), (0, 902, 480.0, 505.0)]
    got = {(r.page, r.point): (r.ord, round(r.dist, 6)) for r in G.nearest_box(spark.createDataFrame(points, "page int, point int, px double, py double"), spark.createDataFrame(boxes, "page int, ord int, x int, y int, w int, h int"), 20.0, cell).collect()}
    want = {}
    for p, k, x, y in points:
        best = min((math.hypot(max(bx - x, 0, x - bx - w), max(by - y, 0, y - by - h)), o) for q, o, bx, by, w, h in boxes if q == p)
        if best[0] < 20:
            want[p, k] = (best[1], round(best[0], 6))
    assert got == want and got[0, 900] == (99, 0.0) and got[0, 901][0] == 99 and (0, 902) not in got


def test_segments_join_neighbours(spark):
    boxes = [(0, 0, 90, 220, 120, 160), (0, 1, 355, 255, 90, 90), (0, 2, 605, 270, 90, 60), (0, 3, 865, 265, 70, 70), (0, 4, 1105, 270, 90, 60), (0, 5, 670, 100, 60, 50)]
    lines = [(0, 1, 150.0, 300.0, 400.0, 300.0), (0, 2, 400.0, 300.0, 650.0, 300.0), (0, 3, 900.0, 300.0, 650.0, 300.0), (0, 4, 0.0, 0.0, 400.0, 300.0), (0, 5, 400.0, 300.0, 402.0, 300.0), (1, 6, 150.0, 300.0, 400.0, 300.0)]
    edges = G.segment_edges(spark.createDataFrame(lines, "page int, seg_id bigint, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(boxes, "page int, ord int, x int, y int, w int, h int"))
    assert sorted((r.a, r.b) for r in edges.collect()) == [(0, 1), (1, 2), (2, 3)]


def test_suppression(spark):
    rows = [(0, 0, (10, 10, 50, 50), "Gate Valve", 0.4), (0, 1, (12, 12, 52, 52), "Ball Valve", 0.9), (0, 2, (200, 200, 240, 240), "x", 0.3), (1, 3, (0, 0, 10, 10), "a", 0.5), (1, 4, (0, 0, 10, 10), "b", 0.5), (1, 5, (0, 0, 10, 20), "c", 0.1)]
    df = spark.createDataFrame(rows, "page int, ord bigint, xyxy struct<x0 int, y0 int, x1 int, y1 int>, class_name string, confidence double")
    assert sorted(r.ord for r in G.suppress_overlaps(df).collect()) == [1, 2, 3, 5]  # an overlap of just the threshold stays


def test_tiles(spark):
    df = spark.createDataFrame([(0, 200, 200), (1, 1500, 640), (2, 641, 1184)], "page int, width int, height int")
    got = {}
    for r in G.tile_offsets(df).orderBy("page", "tile_no").collect():
        got.setdefault(r.page, []).append((r.tile_x, r.tile_y))
    assert got == {0: [(0, 0)], 1: [(0, 0), (544, 0), (860, 0)], 2: [(0, 0), (1, 0), (0, 544), (1, 544)]}


def test_detected_shapes(spark):
    cols = "page int, ord bigint, xyxy struct<x0 int, y0 int, x1 int, y1 int>, class_name string, confidence double, tile_x int, tile_y int"
    rows = [(0, 0, (600, 10, 640, 51), "Gate Valve", 0.5, 0, 0), (0, 1, (56, 10, 96, 51), "Gate Valve", 0.6, 544, 0), (0, 2, (1, 1, 5, 5), "x", 0.1, 0, 0), (1, 0, (1, 1, 9, 9), "a", 0.5, 0, 0), (1, 1, (1, 1, 9, 9), "b", 0.5, 0, 0)]
    pages = spark.createDataFrame([(0, 1000.0, 500.0), (1, 640.0, 640.0)], "page int, width double, height double")
    got = sorted((r.page, r.ord, r.kind, tuple(r.bbox), tuple(r.center)) for r in G.detected_shapes(spark.createDataFrame(rows, cols), pages).collect())
    assert got == [(0, 1, "gate_valve", (600, 10, 40, 41), (620, 30)), (1, 0, "a", (1, 1, 8, 8), (5, 5)), (1, 1, "b", (1, 1, 8, 8), (5, 5))]


def test_label_search(spark):
    pages = spark.createDataFrame([(0, 1000.0, 1000.0)], "page int, width double, height double")
    words = spark.createDataFrame([(0, k, t, x, y, 40, 20) for k, (t, x, y) in enumerate([("P-745", 100, 100), ("p=745", 110, 105), ("AC—746", 700, 700), ("MV-701", 400, 400), ("T-101", 500, 500), ("  ", 0, 0), ("E-742", 980, 980)])], "page int, ord bigint, text string, left int, top int, width int, height int")
    known = spark.createDataFrame([(0, 510, 600, 20, 300)], "page int, x int, y int, w int, h int")
    got = sorted((r.ord, r.kind, tuple(r.bbox), tuple(r.center)) for r in G.label_candidates(words, known, pages).collect())
    assert [g[0] for g in got] == [0, 2, 6]
    assert got[0][1:] == ("equipment_label_region", (0, 0, 340, 330), (120, 110))
    shapes = spark.createDataFrame([(0, 5, (450, 450, 200, 200)), (0, 6, (0, 0, 10, 10))], "page int, ord bigint, bbox struct<x int, y int, w int, h int>")
    assert {r.ord: r.tag for r in G.known_equipment_tags(shapes, words, pages).collect()} == {5: "T-101", 6: "P-745"}


def test_clusters_against_union_find(spark):
    rng = random.Random(4)
    boxes = [(p, k, x := rng.uniform(0, 400), y := rng.uniform(0, 400), x + rng.uniform(1, 15), y + rng.uniform(1, 15)) for p in range(2) for k in range(150)]
    boxes += [(2, k, 10.0 * k, 0.0, 10.0 * k + 5, 5.0) for k in range(200)]  # a long chain
    root = {(p, k): (p, k) for p, k, *_ in boxes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(boxes):
        for b in boxes[i + 1 :]:
            if a[0] == b[0] and not (a[4] + 6 < b[2] or b[4] + 6 < a[2] or a[5] + 6 < b[3] or b[5] + 6 < a[3]):
                x, y = sorted((find(a[:2]), find(b[:2])))
                root[y] = x
    df = spark.createDataFrame(boxes, "page int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.page, r.ord): r.root for r in G.clusters(df).collect()} == {k: find(k)[1] for k in root}
    assert G.coil_regions(df).where("page = 2").collect()[0].arcs == 200
    assert G.clusters(df.limit(0)).collect() == []
