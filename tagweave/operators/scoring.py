"""Scores of extracted graphs against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.geometry import distance, iou_boxes, middle


def category_coverage(truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """(category, ground_truth_count, detected_count, coverage_pct) of each category of truth(category)."""
    want = truth.groupBy("category").agg(F.count("*").alias("ground_truth_count"))
    got = nodes.groupBy(S.coarse3_or_unknown(F.col("component_type")).alias("category")).agg(F.count("*").alias("n"))
    on = want.join(got, "category", "left").withColumn("detected_count", F.coalesce("n", F.lit(0)))
    share = F.round(100.0 * F.least("detected_count", "ground_truth_count") / F.col("ground_truth_count"), 1)
    return on.select("category", "ground_truth_count", "detected_count", share.alias("coverage_pct"))


def tag_sides(truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tag, expected, found) of all normalised tags of either side."""
    want = truth.select(S.normal_tag(F.col("tag")).alias("tag")).distinct().withColumn("expected", F.lit(True))
    got = nodes.where("tag is not null and tag <> ''").select(S.normal_tag(F.col("tag")).alias("tag")).distinct().withColumn("found", F.lit(True))
    both = want.join(got, "tag", "full_outer")
    return both.select("tag", F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("found", F.lit(False)).alias("found"))


def _rates(df: DataFrame) -> DataFrame:
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall))
    return df.select("*", *[F.round(v, 3).alias(n) for n, v in (("precision", precision), ("recall", recall), ("f1", f1))])


def tag_accuracy(truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1. Rates of nothing are null, and so is an f1 of a rate of 0."""
    sides = tag_sides(truth, nodes)
    return _rates(sides.agg(F.count_if(F.col("expected") & F.col("found")).alias("tp"), F.count_if(F.col("found") & ~F.col("expected")).alias("fp"), F.count_if(F.col("expected") & ~F.col("found")).alias("fn")))


def missed_tags(truth: DataFrame, nodes: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` expected tags that weren't found."""
    return tag_sides(truth, nodes).where("expected and not found").select("tag").orderBy("tag").limit(n)


def binary_rates(labelled: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of two boolean columns."""
    p, a = F.col(predicted), F.col(actual)
    return _rates(labelled.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn")))


def _reaches(nodes: DataFrame, reach: float) -> list[float]:
    """Up to ``reach``, each four times the one before; the first such that a node of nodes(page, category, nx, ny) has a few of its category within it."""
    size = lambda c: F.max(c) - F.min(c) + 1
    per = nodes.groupBy("page", "category").agg(F.count("*").alias("n"), (size("nx") * size("ny")).alias("area"))
    room = per.agg(F.try_divide(F.sum("area"), F.sum("n"))).first()[0]
    out = [reach]
    while room and out[0] / 4 > max(1.0, float(room) ** 0.5):
        out.insert(0, out[0] / 4)
    return out


def nearest_detections(truth: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """truth(gt_id, page, category, bbox) with the nearest node of its page and category: matched, distance, iou.

    The distance is given even beyond ``reach`` (which is within it); of equally near nodes the first by ord. One
    node may serve several. iou is 0 without a match, and rounded to 3 digits; distances to 1.
    """
    from ..plans.session import cut

    tx, ty = middle(F.col("bbox"))
    want = truth.select("gt_id", "page", "category", F.col("bbox").alias("gt_bbox"), tx.alias("tx"), ty.alias("ty"))
    nx, ny = middle(F.col("bbox"))
    got = nodes.select("page", S.coarse3_or_unknown(F.col("component_type")).alias("category"), "ord", "bbox", nx.alias("nx"), ny.alias("ny"))
    best = lambda on: on.groupBy("gt_id").agg(F.min_by(F.struct("page", "category", "gt_bbox", "bbox", "dist"), F.struct(F.col("dist").isNull(), "dist", "ord")).alias("v")).select("gt_id", "v.*")
    dist = distance(F.col("tx"), F.col("ty"), F.col("nx"), F.col("ny"))
    # what has a node within a short reach, in a cell round its own, needs no longer one, which would meet more nodes the
    # more there are; only what has none within the longest is compared with all of its category
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    node = F.min(F.when(F.col("dist") <= F.col("reach"), F.struct("dist", "ord", "bbox"))).alias("n")
    parts, left, got = [], want, cut(got)
    for near in _reaches(got, max(1.0, float(reach))):
        cell = lambda df, x, y: df.withColumns({"cx": F.floor(F.col(x) / near), "cy": F.floor(F.col(y) / near)})  # noqa: E731, B023
        round_ = cell(left, "tx", "ty").withColumn("s", F.explode(steps)).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")}).drop("s")
        met = round_.join(cell(got, "nx", "ny"), ["page", "category", "cx", "cy"]).withColumns({"dist": dist, "reach": F.lit(min(near, float(reach)))})
        hits = met.groupBy("gt_id").agg(node).where("n is not null")
        tried = cut(left.join(hits, "gt_id", "left"))
        parts.append(tried.where("n is not null").select("gt_id", "page", "category", "gt_bbox", "n.bbox", "n.dist"))
        left = tried.where("n is null").drop("n")
    best = best(left.join(got, ["page", "category"], "left").withColumn("dist", dist))
    for part in parts:
        best = best.unionByName(part)
    matched = F.coalesce(F.col("dist") <= reach, F.lit(False))
    iou = F.when(matched, F.round(iou_boxes(F.col("gt_bbox"), F.col("bbox")), 3)).otherwise(0.0)
    return best.select("gt_id", "page", "category", "gt_bbox", matched.alias("matched"), F.round("dist", 1).alias("nearest_center_distance_px"), F.when(matched, F.col("bbox")).alias("matched_bbox"), iou.alias("iou"))


def box_score(rows: DataFrame) -> DataFrame:
    """One row: sample_size, matched_count, unmatched_count, mean iou over matched rows and over all (null of none)."""
    hit = F.col("matched")
    return rows.agg(
        F.count("*").alias("sample_size"), F.count_if(hit).alias("matched_count"), F.count_if(~hit).alias("unmatched_count"),
        F.round(F.avg(F.when(hit, F.col("iou"))), 3).alias("mean_iou_matched"), F.round(F.avg("iou"), 3).alias("mean_iou_all"),
    )


def numbered(truth: DataFrame) -> DataFrame:
    """truth with gt_id, its order on the page."""
    return truth.withColumn("gt_id", F.row_number().over(Window.partitionBy("page").orderBy("category", "tag", "bbox")))


def score(truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row, all of a score: coverage (an array by category), tags (tp, fp, fn and rates) and the first missed tags."""
    coverage = category_coverage(truth, nodes).agg(F.sort_array(F.collect_list(F.struct("category", "ground_truth_count", "detected_count", "coverage_pct"))).alias("coverage"))
    named = truth.where("tag is not null and tag <> ''")
    tags = tag_accuracy(named, nodes).select(F.struct("tp", "fp", "fn", "precision", "recall", "f1").alias("tags"))
    missed = missed_tags(named, nodes).agg(F.sort_array(F.collect_list("tag")).alias("missed"))
    return coverage.crossJoin(tags).crossJoin(missed)
