"""Page graphs and the full run, from tables of primitives.

All pages are one plan, keyed by page; tables of several documents have a column doc_id too, and are keyed by both.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import crossref, detectors, graph, spatial, text
from ..sources import sinks
from .session import cut


class Primitives(NamedTuple):
    """Tables of ``schemas``; those that are None aren't there, as if their adapter was off."""

    pages: DataFrame
    drawings: DataFrame | None = None
    contours: DataFrame | None = None
    detections: DataFrame | None = None
    words: DataFrame | None = None
    reads: DataFrame | None = None  # (page, shape_id, attempt, raw_text)
    raster_segments: DataFrame | None = None
    model_tags: DataFrame | None = None  # (page, shape_id, reply)
    model_types: DataFrame | None = None  # (page, shape_id, reply)
    find_labels: bool = False


def page_shapes(p: Primitives) -> DataFrame:
    """page, shape_id, kind, bbox, source, override of all plausible shapes, then of label regions."""
    found: dict[str, DataFrame] = {}
    if p.drawings is not None:
        found |= {"circle": detectors.circles(p.drawings, p.pages), "valve": detectors.valves(p.drawings, p.pages), "vessel": detectors.vessels(p.drawings, p.pages)}
    if p.contours is not None:
        found["raster"] = detectors.contour_shapes(p.contours, p.pages)
    if p.detections is not None:
        found["detector"] = spatial.detected_shapes(p.detections, p.pages)
    if not found:
        raise ValueError("there are no shapes without drawings, contours or detections")
    merged = graph.merge_shapes(found)
    shapes = graph.plausible_shapes(merged)
    if p.find_labels and p.words is not None:
        known = found["vessel"].select("page", "bbox.*") if "vessel" in found else shapes.limit(0).select("page", "bbox.*")
        regions = spatial.label_candidates(p.words, known, p.pages)
        # numbers go on after the merged list's, so none is used twice
        last = merged.groupBy("page").agg(F.max("shape_id").alias("last"))
        nth = F.row_number().over(Window.partitionBy("page").orderBy("ord"))
        regions = regions.withColumn("nth", nth).join(last, "page", "left")
        shapes = shapes.unionByName(regions.select("page", (F.coalesce("last", F.lit(-1)) + F.col("nth")).alias("shape_id"), "kind", "bbox", F.lit("label").alias("source"), F.lit("equipment").alias("override")))
    return shapes


def tag_shapes(p: Primitives, shapes: DataFrame) -> DataFrame:
    """SYMBOLS: shapes with tag, raw text, source of the tag and final override. Each step only fills gaps."""
    out = shapes.select("page", F.col("shape_id").alias("ord"), "shape_id", "kind", "bbox", "override")
    if p.reads is not None:
        first = text.first_success(p.reads.withColumnRenamed("shape_id", "ord"))
        out = out.join(first, ["page", "ord"], "left")
        region = F.col("kind") == "equipment_label_region"  # too large a crop to read one tag from
        out = out.withColumns({"tag": F.when(~region, F.col("tag")), "raw_text": F.when(~region, F.coalesce("raw_text", F.lit("")))})
    else:
        out = out.withColumns({"tag": F.lit(None).cast("string"), "raw_text": F.lit("")})
    out = out.withColumn("source", F.lit(None).cast("string"))
    for given, tags, raw, source in _fillers(p, out):
        filled = given.select("page", "ord", tags.alias("new"), raw.alias("new_raw")).where("new is not null")
        out = out.join(filled, ["page", "ord"], "left").withColumns({"source": F.when(F.col("new").isNotNull(), source).otherwise(F.col("source")), "raw_text": F.coalesce("new_raw", "raw_text"), "tag": F.coalesce("tag", "new")}).drop("new", "new_raw")
    if p.model_types is not None:
        kinds = p.model_types.select("page", F.col("shape_id").alias("ord"), S.classification(F.col("reply")).alias("c"))
        wanted = graph.needs_model_type(out).select("page", "ord").join(kinds, ["page", "ord"]).select("page", "ord", F.coalesce("c.subtype", "c.coarse").alias("new"))
        out = out.join(wanted, ["page", "ord"], "left").withColumn("override", F.coalesce("override", "new")).drop("new")
    return out


def _fillers(p: Primitives, out: DataFrame):
    taken = None
    if p.find_labels and p.words is not None:
        found = spatial.known_equipment_tags(graph.needs_label_search(out), p.words, p.pages)
        taken = found.select("page", "ord")
        yield found, F.col("tag"), F.col("tag"), "equipment_label_discovery"
    if p.model_tags is not None:
        open_ = graph.needs_model_tag(out).select("page", "ord")
        if taken is not None:
            open_ = open_.join(taken, ["page", "ord"], "left_anti")
        replies = open_.join(p.model_tags.select("page", F.col("shape_id").alias("ord"), "reply"), ["page", "ord"])
        yield replies, S.loose_tag(F.col("reply")), F.col("reply"), "llm_assisted"


def page_edges(p: Primitives, shapes: DataFrame) -> DataFrame:
    """(page, a, b) by shape_id: from vector segments, or on pages that have none so, from raster segments."""
    boxes = shapes.select("page", F.col("shape_id").alias("ord"), "bbox.*")
    none = boxes.limit(0).select("page", F.col("ord").alias("a"), F.col("ord").alias("b"))
    vector = spatial.segment_edges(detectors.segments(p.drawings, p.pages), boxes) if p.drawings is not None else none
    return graph.fallback_edges(vector, spatial.segment_edges(p.raster_segments, boxes)) if p.raster_segments is not None else vector


def by_document(p: Primitives) -> Primitives:
    """The same tables, with doc_id packed into page where they have one."""
    return Primitives(*[graph.keyed(x) if isinstance(x, DataFrame) else x for x in p])


def page_graphs(p: Primitives) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each page by itself. With doc_id in the tables, page is struct(doc_id, page) in the results."""
    p = by_document(p)
    shapes = page_shapes(p)
    nodes = graph.label_nodes(tag_shapes(p, shapes))
    return nodes, graph.label_edges(page_edges(p, shapes), nodes)


def one_page(p: Primitives, page: int, doc_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph of one page (of one document, where tables have doc_id); ValueError if there is no such page."""
    here = (F.col("page") == page) if doc_id is None else (F.col("page") == page) & (F.col("doc_id") == doc_id)
    if p.pages.where(here).isEmpty():
        raise ValueError(f"there is no page {page}")
    only = lambda x: x.where(here) if isinstance(x, DataFrame) else x
    return page_graphs(Primitives(*[only(x) for x in p]))


def place(nodes: DataFrame) -> DataFrame:
    """Nodes of a composed graph with their order, ``place``; first_page and first_ord fit in one number."""
    return nodes.withColumn("place", F.col("first_page").cast("bigint") * (1 << 40) + F.col("first_ord"))


def whole_graph(p: Primitives) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``place``, edges) of all pages in one; with doc_id in the tables, of each document's pages in one."""
    nodes, edges = graph.compose_pages(*page_graphs(p))
    return place(nodes), edges


def findings(nodes: DataFrame, edges: DataFrame, procedures: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """All findings between a graph and procedures (SOP_DOCS), and between title blocks and limit tables."""
    out = crossref.graph_findings(nodes, edges, text.referenced_tags(procedures), text.declared_types(procedures), text.stated_connections(procedures))
    if headers is not None:
        limits = text.equipment_limits(procedures)
        out = out.unionByName(crossref.limit_findings(text.title_limits(headers, limits.select("tag").distinct()), limits))
    return out


def report(nodes: DataFrame, edges: DataFrame, procedures: DataFrame, headers: DataFrame | None, folder: str) -> DataFrame:
    """Writes a graph and its report into ``folder``, returns the findings in order. Nodes and edges are read often: cut them."""
    found = cut(findings(nodes, edges, procedures, headers))
    sinks.write_graph(nodes, edges, folder)
    sinks.write_report(found, folder)
    return crossref.ordered(found)


def run(p: Primitives, procedures: DataFrame, headers: DataFrame, folder: str) -> DataFrame:
    """The full run, of one document: writes graph and report into ``folder``, returns the findings in order."""
    nodes, edges = (cut(x) for x in whole_graph(p))
    return report(nodes, edges, procedures, headers, folder)
