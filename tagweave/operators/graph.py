"""The component graph: nodes and edges as two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as S
from .numbering import number_rows

LARGEST_SYMBOL = 150
#: Sources of shapes, the most trusted first.
SOURCES = ("circle", "valve", "vessel", "raster", "detector")


def merge_shapes(by_source: dict[str, DataFrame]) -> DataFrame:
    """All shapes, numbered anew on each page: page, shape_id, kind, bbox, source, override.

    Vector shapes come first, then raster shapes, then a detector's, each in its own order (``ord``). A detector's
    class name gives its component type, as an override.
    """
    parts = []
    for rank, source in enumerate(s for s in SOURCES if s in by_source):
        override = S.type_of_class(S.class_words(F.col("kind"))) if source == "detector" else F.lit(None).cast("string")
        parts.append(by_source[source].select("page", F.lit(rank).alias("rank"), "ord", "kind", "bbox", F.lit(source).alias("source"), override.alias("override")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = number_rows(both, ["page"], ["ord"], "nth", lead=("rank",))
    return both.select("page", (F.col("nth") - 1).cast("bigint").alias("shape_id"), "kind", "bbox", "source", "override")


def longest_side(bbox: Column) -> Column:
    return F.greatest(bbox["w"], bbox["h"])


def is_plausible(kind: Column, override: Column, bbox: Column) -> Column:
    """False for valves and instruments that are larger than any that is drawn; equipment may be large."""
    coarse = F.coalesce(S.coarse3(S.geometric_type(kind, override)), F.lit(""))
    return ~(coarse.isin("valve", "instrument") & (longest_side(bbox) > LARGEST_SYMBOL))


def plausible_shapes(shapes: DataFrame) -> DataFrame:
    return shapes.where(is_plausible(F.col("kind"), F.col("override"), F.col("bbox")))


def needs_label_search(shapes: DataFrame) -> DataFrame:
    """Large equipment that has no tag yet."""
    return shapes.where(F.col("tag").isNull() & (S.coarse3(S.geometric_type(F.col("kind"), F.col("override"))) == "equipment") & (longest_side(F.col("bbox")) > LARGEST_SYMBOL))


def needs_model_tag(shapes: DataFrame) -> DataFrame:
    """Shapes without a tag that are small enough for a model to read."""
    return shapes.where(F.col("tag").isNull() & (longest_side(F.col("bbox")) <= LARGEST_SYMBOL))


def needs_model_type(shapes: DataFrame) -> DataFrame:
    """Small shapes of which neither tag nor override nor outline says what they are."""
    return shapes.where(S.type_of_tag(F.col("tag")).isNull() & F.col("override").isNull() & (S.type_of_kind(F.col("kind")) == "unknown") & (longest_side(F.col("bbox")) <= LARGEST_SYMBOL))


def label_nodes(symbols: DataFrame) -> DataFrame:
    """Nodes of symbols(page, ord, shape_id, kind, bbox, tag, raw_text, source, override).

    The first symbol of a page with a tag is labelled by it, the n-th ``tag (dup n)``; those without a tag by their
    number. All keep their tag.
    """
    tag = F.col("tag")
    # symbols without a tag need no number, and would be one task
    nth = F.row_number().over(Window.partitionBy("page", "tag", F.when(tag.isNull(), F.col("ord"))).orderBy("ord"))
    label = F.when(tag.isNull(), F.concat(F.lit("UNLABELED-"), F.col("shape_id").cast("string"))).when(F.col("nth") == 1, tag).otherwise(F.concat(tag, F.lit(" (dup "), F.col("nth").cast("string"), F.lit(")")))
    return symbols.withColumn("nth", nth).select(
        label.alias("label"), "page", "ord", "shape_id", "tag", F.col("raw_text").alias("ocr_raw_text"), F.col("kind").alias("symbol_kind"),
        S.component_type(tag, F.col("kind"), F.col("override")).alias("component_type"), "bbox", S.tag_confidence(tag, F.col("source")).alias("tag_confidence"),
    )


def label_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (page, a, b) by labels, a <= b, of edges(page, a, b) by shape_id; edges of unknown shapes are dropped."""
    name = lambda c: nodes.select("page", F.col("shape_id").alias(c), F.col("label").alias(f"{c}_label"))
    on = edges.join(name("a"), ["page", "a"]).join(name("b"), ["page", "b"])
    return on.select("page", F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).distinct()


def fallback_edges(vector: DataFrame, raster: DataFrame) -> DataFrame:
    """A page's vector edges, or its raster edges where there are none."""
    return vector.unionByName(raster.join(vector.select("page").distinct(), "page", "left_anti"))


def _on_page(label: Column, page: Column) -> Column:
    return F.when(label.startswith("UNLABELED-"), F.concat(F.lit("UNLABELED-P"), page.cast("string"), F.lit("-"), label)).otherwise(label)


def is_keyed(df: DataFrame) -> bool:
    """Whether ``page`` is struct(doc_id, page): pages of several documents, told apart by both."""
    return isinstance(df.schema["page"].dataType, StructType)


def keyed(df: DataFrame) -> DataFrame:
    """A table with a column doc_id, with it packed into ``page``; others as they are."""
    return df.withColumn("page", F.struct("doc_id", "page")).drop("doc_id") if "doc_id" in df.columns and not is_keyed(df) else df


def compose_pages(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph of all pages, or of all pages of each document: (nodes, edges).

    Unlabelled nodes are told apart by page. Nodes of one label are one: the last page's attributes at the first
    page's place (columns first_page, first_ord). Of keyed pages both tables have doc_id, and nothing is joined
    across documents.
    """
    doc = ["doc_id"] if is_keyed(nodes) else []
    if doc:
        nodes, edges = (x.select(F.col("page.doc_id").alias("doc_id"), F.col("page.page").alias("page"), *[c for c in x.columns if c != "page"]) for x in (nodes, edges))
    named = nodes.withColumn("label", _on_page(F.col("label"), F.col("page")))
    rest = [c for c in named.columns if c not in ("label", *doc)]
    whole = named.groupBy(*doc, "label").agg(F.max_by(F.struct(*rest), F.struct("page", "ord")).alias("n"), F.min(F.struct("page", "ord")).alias("first"))
    merged = whole.select(*doc, "label", "n.*", F.col("first.page").alias("first_page"), F.col("first.ord").alias("first_ord"))
    ends = edges.select(*doc, _on_page(F.col("a"), F.col("page")).alias("a"), _on_page(F.col("b"), F.col("page")).alias("b"))
    return merged, ends.select(*doc, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
