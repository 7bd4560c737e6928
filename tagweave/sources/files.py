"""Readers of ground truth, label files, class names and primitive tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMPONENT = "struct<page: int, category: string, tag: string, symbol: string, bbox: array<double>, source: string>"


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """page, category, tag, symbol, bbox(x, y, w, h), source of JSON documents with ``components``."""
    docs = spark.read.schema(f"page_index int, components array<{_COMPONENT}>").json(path, multiLine=True)
    rows = docs.select("page_index", F.posexplode("components").alias("nth", "c"))
    box = F.when(F.size("c.bbox") == 4, F.struct(*[F.get("c.bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")]))
    return rows.select(F.coalesce("c.page", "page_index").alias("page"), "nth", "c.category", "c.tag", "c.symbol", box.alias("bbox"), "c.source")


def node_link_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``place``, edges) of a graph that ``sinks.write_graph`` (or another node-link writer) wrote."""
    node = "struct<id: string, shape_id: bigint, tag: string, ocr_raw_text: string, symbol_kind: string, component_type: string, bbox: array<int>, tag_confidence: string>"
    docs = spark.read.schema(f"nodes array<{node}>, edges array<struct<source: string, target: string>>").json(path, multiLine=True)
    nodes = docs.select(F.posexplode("nodes").alias("place", "n"))
    box = F.struct(*[F.get("n.bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh")])
    nodes = nodes.select(F.col("n.id").alias("label"), F.col("place").cast("bigint").alias("place"), "n.shape_id", "n.tag", "n.ocr_raw_text", "n.symbol_kind", "n.component_type", box.alias("bbox"), "n.tag_confidence")
    edges = docs.select(F.explode("edges").alias("e")).select(F.least("e.source", "e.target").alias("a"), F.greatest("e.source", "e.target").alias("b"))
    return nodes, edges.distinct()


def _stem(path) -> F.Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text) of label files, whole."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(_stem(F.col("path")).alias("stem"), F.col("value").alias("text"))


def image_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(stem, path) of a directory's files; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")
    return files.select(_stem(F.col("path")).alias("stem"), "path").orderBy("path")


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name) of the ``names`` list in a YAML file, inline or with a dash on each line."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r", "").alias("t"))
    inline = F.regexp_extract("t", r"(?m)^names:\s*\[([^\]]*)\]", 1)
    block = F.regexp_extract("t", r"(?m)^names:[ \t]*\n((?:\s*-[^\n]*\n?)+)", 1)
    items = F.when(F.length(inline) > 0, F.split(inline, ",")).otherwise(F.regexp_extract_all(block, F.lit(r"-\s*([^\n]*)"), F.lit(1)))
    clean = F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", ""))
    return text.select(F.posexplode(clean).alias("class_id", "name"))


def model_file(path: str | None, default: str) -> str | None:
    """The path of a model's weights if there are any; the default is looked up when this is called."""
    found = path or os.environ.get("DETECTOR_WEIGHTS") or default
    return found if os.path.exists(found) else None
