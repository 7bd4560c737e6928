"""python -m tagweave --pid diagram.pdf --sop procedures/ --out report/

Reads a diagram's pages and procedures, writes graph and report, and prints what it counted.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import crossref, text
from .plans import pages
from .sources import adapters, docx, raster


def counts(nodes: DataFrame, edges: DataFrame, procedures: DataFrame, limits: DataFrame, titles: DataFrame, found: DataFrame) -> list[str]:
    """The lines that a run prints."""
    tags, known, read = text.referenced_tags(procedures).select("tag").distinct(), limits.select("tag").distinct(), titles.select("tag").distinct()
    s = crossref.severity_counts(found).first()
    return [
        f"Diagram: {nodes.count()} components, {edges.count()} connections",
        f"Procedures: {tags.count()} tags referenced, {known.count()} tags in tables of limits",
        f"Title blocks: limits of {read.count()} of {known.count()} tags",
        f"Findings: {s.errors} error(s), {s.warnings} warning(s), {s.infos} info",
    ]


def primitives(files: DataFrame, model: str | None = None, dpi: int = 200) -> tuple[pages.Primitives, DataFrame]:
    """(what the adapters find in PDF files(path, content), images of the pages); ``model``: a vision model's URL."""
    images = adapters.pdf_images(files, dpi)
    p = pages.Primitives(adapters.pdf_pages(files, dpi), drawings=adapters.pdf_drawings(files), contours=raster.contours(images))
    shapes = pages.page_shapes(p)
    p = p._replace(reads=raster.label_reads(images, shapes).withColumnRenamed("ord", "shape_id"), raster_segments=raster.raster_segments(images, shapes))
    if model and adapters.available(model):
        crops = adapters.label_crops(images, shapes)
        replies = adapters.model_replies(crops, model, "llama3.2-vision:11b", adapters.READ_PROMPT)
        p = p._replace(model_tags=replies.withColumnRenamed("ord", "shape_id"))
    return p, images


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tagweave", description=__doc__)
    parser.add_argument("--pid", required=True, help="a diagram as PDF")
    parser.add_argument("--sop", required=True, help="a procedure, or a folder of them, as .docx")
    parser.add_argument("--out", default="output")
    parser.add_argument("--model", help="URL of a vision model that reads tags again which OCR missed")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tagweave").getOrCreate()
    procedures = docx.procedures(spark, args.sop)
    p, images = primitives(spark.read.format("binaryFile").load(args.pid), args.model)
    nodes, edges = (pages.cut(x) for x in pages.whole_graph(p))
    heads = pages.cut(raster.headers(images).selectExpr("page.page as page", "text"))
    found = pages.report(nodes.drop("doc_id"), edges.drop("doc_id"), procedures, heads, args.out)
    limits = text.equipment_limits(procedures)
    for line in counts(nodes, edges, procedures, limits, text.title_limits(heads, limits.select("tag").distinct()), found):
        print(line)


if __name__ == "__main__":
    main()
