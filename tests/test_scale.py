"""Steps that must not hold a whole page, or all pairs of a dense one."""

import math
import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagweave.operators import detectors, graph, scoring, spatial
from tagweave.operators.numbering import number_rows
from tagweave.plans import queries as core
from tagweave.plans.views import view

from .helpers import oracle_rows, rows_of


def spread_over(spark, df):
    """Rows of the largest and number of the non-empty tasks of 16."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "16", "-1")):
        spark.conf.set(k, v)
    try:
        per = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return max(per), len(per)


def test_numbers_equal_those_of_one_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 1, None]), rng.choice("ab"), rng.choice([None, rng.randrange(-90, 90)]), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "page int, rank string, ord bigint, k int")
    got = number_rows(df, ["page"], ["ord", "k"], "n", lead=("rank",), width=7)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("rank", "ord", "k")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_symbols_of_a_page_are_in_several_tasks(spark):
    sym = view(spark, "/root/testdata/sf0.01", "sym")
    most, tasks = spread_over(spark, sym.select("page", "ord", "x"))
    assert tasks > 3 and most < 60000 / 3


def test_symbols_without_a_tag_are_in_several_tasks(spark):
    n = spark.range(5000).select(F.lit(0).alias("page"), F.col("id").alias("ord"), F.col("id").alias("shape_id"), F.lit("circle").alias("kind"), F.expr("struct(1 as x, 1 as y, 1 as w, 1 as h)").alias("bbox"))
    none = F.lit(None).cast("string")
    nodes = graph.label_nodes(n.select("*", F.when(F.col("ord") % 1000 == 0, F.lit("P-1")).alias("tag"), none.alias("raw_text"), none.alias("source"), none.alias("override")))
    most, tasks = spread_over(spark, nodes.select("label", "ord"))
    assert tasks > 4 and most < 2500
    assert {r.label for r in nodes.where("ord % 1000 = 0 or ord = 7").collect()} == {"P-1", "P-1 (dup 2)", "P-1 (dup 3)", "P-1 (dup 4)", "P-1 (dup 5)", "UNLABELED-7"}


def test_nearest_of_boxes_upon_each_other(spark):
    """100,000 points in 100,000 boxes: all pairs would be ten billion."""
    n = 100_000
    boxes = spark.range(n).selectExpr("0 as page", "(id * 7919 + 13) % 100000 as ord", "cast(id % 40 as int) as x", "cast(id % 37 as int) as y", "100 as w", "100 as h")
    points = spark.range(n).selectExpr("0 as page", "id as point", "cast(id % 150 as double) as px", "cast(id % 149 as double) as py")
    begin = time.time()
    got = {r.point: (r.ord, r.dist) for r in spatial.nearest_box(points, boxes).where("point < 3000").collect()}
    assert time.time() - begin < 120
    least = {}
    for r in boxes.groupBy("x", "y").agg(F.min("ord").alias("ord")).collect():
        least[r.x, r.y] = r.ord
    for k in range(0, 3000, 97):
        px, py = k % 150, k % 149
        dist = {xy: math.hypot(max(xy[0] - px, 0, px - xy[0] - 100), max(xy[1] - py, 0, py - xy[1] - 100)) for xy in least}
        best = min((d, least[xy]) for xy, d in dist.items())
        assert got.get(k) == ((best[1], best[0]) if best[0] < 20 else None)


def test_a_point_at_several_places_has_the_nearest_of_all(spark):
    points = spark.createDataFrame([(0, 1, 5.0, 5.0), (0, 1, 105.0, 5.0), (0, 2, 105.0, 5.0), (0, 2, 212.0, 5.0), (0, 3, 215.0, 5.0)], "page int, point int, px double, py double")
    boxes = spark.createDataFrame([(0, 9, 0, 0, 10, 10), (0, 4, 100, 0, 10, 10), (0, 1, 200, 0, 10, 10)], "page int, ord int, x int, y int, w int, h int")
    assert {(r.point, r.ord, r.dist) for r in spatial.nearest_box(points, boxes).collect()} == {(1, 4, 0.0), (2, 4, 0.0), (3, 1, 5.0)}


def test_clusters_of_boxes_upon_each_other(spark):
    """150,000 boxes on a small place have ten billion near pairs; those in a row far off are apart or not by their gap alone."""
    n = 150_000
    dense = spark.range(n).selectExpr("0 as page", "id as ord", "cast(id % 90 as double) as x0", "cast(id % 70 as double) as y0", "cast(id % 90 + 4 + id % 3 as double) as x1", "cast(id % 70 + 5 as double) as y1")
    row = spark.createDataFrame([(0, n + k, 1000.0 + 8 * k, 0.0, 1004.0 + 8 * k - (k == 5), 4.0) for k in range(9)], dense.schema)
    begin = time.time()
    got = sorted((r.root, r.arcs, r.x0, r.y0, r.x1, r.y1) for r in spatial.coil_regions(dense.unionByName(row), 4.0, 1).collect())
    assert time.time() - begin < 120
    assert got == [(0, n, 0.0, 0.0, 95.0, 74.0), (n, 6, 1000.0, 0.0, 1043.0, 4.0), (n + 6, 3, 1048.0, 0.0, 1068.0, 4.0)]


def test_clusters_that_meet_at_corners(spark):
    rng = random.Random(9)
    boxes = [(p, k, x := rng.randrange(60), y := rng.randrange(60), x + rng.choice([2, 3, 9]), y + rng.choice([2, 3, 9])) for p in range(12) for k in range(5 + 5 * p)]
    root = {b[:2]: b[1] for b in boxes}
    for _ in boxes:  # the least number spreads until none changes
        old = dict(root)
        for a in boxes:
            for b in boxes:
                if a[0] == b[0] and not (a[4] + 2 < b[2] or b[4] + 2 < a[2] or a[5] + 2 < b[3] or b[5] + 2 < a[3]):
                    root[a[:2]] = min(root[a[:2]], root[b[:2]])
        if old == root:
            break
    df = spark.createDataFrame([(*b[:2], *map(float, b[2:])) for b in boxes], "page int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.page, r.ord): r.root for r in spatial.clusters(df, 2.0).collect()} == root


def test_detectors_test_sides_before_items(spark):
    """Items of drawings whose sides don't fit aren't looked at: here they would fail."""
    df = spark.range(9).selectExpr("0 as page", "id as draw_id", "'s' as type", "array(struct(if(id >= 0, raise_error('items'), 'l') as op, array(struct(1d as x, 1d as y)) as pts)) as items", "struct(0d as x0, 0d as y0, 400d as x1, 3d as y1) as rect")
    pages = spark.createDataFrame([(0, 72, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))], "page int, dpi int, matrix struct<a double, b double, c double, d double, e double, f double>")
    for kind in (detectors.circles, detectors.valves, detectors.vessels):
        assert kind(df, pages).collect() == []


def test_merged_shapes_of_a_page_are_in_several_tasks(spark):
    some = spark.range(40_000).select(F.lit(0).alias("page"), F.col("id").alias("ord"), F.lit("x").alias("kind"), F.expr("struct(1 as x, 1 as y, 1 as w, 1 as h)").alias("bbox"))
    merged = graph.merge_shapes({"circle": some.where("ord % 2 = 0"), "vessel": some.where("ord % 2 = 1")})
    most, tasks = spread_over(spark, merged)
    assert tasks > 4 and most < 20_000
    got = {r.shape_id: r.source for r in merged.collect()}
    assert sorted(got) == list(range(40_000)) and got[19_999] == "circle" and got[20_000] == "vessel"


def test_nearest_detections_among_many(spark):
    """60,000 of each on one place: all within reach would be over three billion pairs."""
    n = 60_000
    at = "struct(cast(id % 251 as int) as x, cast(id % 239 as int) as y, 4 as w, 4 as h)"
    truth = spark.range(n).selectExpr("id as gt_id", "0 as page", "'valve' as category", f"{at} as bbox")
    nodes = spark.range(n).selectExpr("0 as page", "id as ord", "'gate_valve' as component_type", f"{at} as bbox").where("ord % 11 > 0 and bbox.x > 9")
    begin = time.time()
    got = {r.gt_id: (r.nearest_center_distance_px, r.iou) for r in scoring.nearest_detections(truth, nodes, 120.0).collect()}
    assert time.time() - begin < 120 and len(got) == n
    places = {(k % 251, k % 239) for k in range(n) if k % 11 and k % 251 > 9}
    for k in range(0, n, 1999):
        best = min(math.hypot(x - k % 251, y - k % 239) for x, y in places)
        assert got[k][0] == round(best, 1) and (got[k][1] == 1.0) == (best == 0)


def test_score_document_without_a_missed_tag_equals_its_sql(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_partkey % 200 = 7 and l_suppkey % 6 = 0").limit(1)
    lines.crossJoin(spark.range(600).select(F.col("id"))).withColumn("l_orderkey", F.lit(3).cast("bigint")).drop("id").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = rows_of(core.QUERIES["score_document"](spark, str(tmp_path)))
    assert got == oracle_rows(core.ORACLE_SQL["score_document"], str(tmp_path)) and got[0].count(None) == 1
