"""Facts, limits and title blocks from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import BOUND_TAG, CONNECTION, DECLARATION, HEADER_PREFIX, PRESSURE, ROW_TAG, STANDING_PREFIX, TEMPERATURE, first_match, or_null, stripped, to_float
from ..functions.vocabulary import KEYWORD_TYPES, lookup


def _all(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct<g1, g2, ...>> of all matches."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])


def referenced_tags(docs: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Distinct tags that the texts mention."""
    return docs.select(F.explode(F.regexp_extract_all(F.upper(F.col(text_col)), F.lit(BOUND_TAG), F.lit(1))).alias("tag")).distinct()


def declared_types(docs: DataFrame, text_col: str = "full_text", order: str = "doc_id") -> DataFrame:
    """(tag, declared_type): of several declarations the last one, by document and position."""
    found = docs.select(F.col(order).alias("doc"), F.posexplode(_all(F.col(text_col), DECLARATION, 1, 2, 3, 4)).alias("pos", "m"))
    tag = F.upper(F.coalesce(or_null(F.col("m.g2")), F.col("m.g3")))
    word = F.lower(F.coalesce(or_null(F.col("m.g1")), F.col("m.g4")))
    return found.select("doc", "pos", tag.alias("tag"), lookup(word, KEYWORD_TYPES).alias("kind")).groupBy("tag").agg(F.max_by("kind", F.struct("doc", "pos")).alias("declared_type"))


def stated_connections(docs: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Distinct pairs (a, b), a < b, that a text says are connected. Whole texts are searched, across line breaks."""
    found = docs.select(F.explode(_all(F.upper(F.col(text_col)), CONNECTION, 1, 2)).alias("m")).where("m.g1 <> m.g2")
    return found.select(F.least("m.g1", "m.g2").alias("a"), F.greatest("m.g1", "m.g2").alias("b")).distinct()


def equipment_limits(docs: DataFrame, tables_col: str = "tables") -> DataFrame:
    """Rows of design-limit tables: doc_id, table_no, row_no, tag, raw_label, pressure_psig, temperature_f.

    A table counts if it has two rows and a header cell that says pressure or temp; a row if its first cell starts
    with a tag. Cells that a short row lacks, numbers that are none and blank temperatures are null.
    """
    tables = docs.select("doc_id", F.posexplode(tables_col).alias("table_no", "rows")).where(F.size("rows") >= 2)
    heads = F.transform(F.get("rows", F.lit(0)), lambda c: F.lower(c))
    column = lambda word: F.array_position(F.transform(heads, lambda c: c.contains(word)), True) - 1
    tables = tables.select("doc_id", "table_no", "rows", column("pressure").alias("p"), column("temp").alias("t")).where("p >= 0 or t >= 0")
    rows = tables.select("doc_id", "table_no", "p", "t", F.posexplode("rows").alias("row_no", "row")).where("row_no > 0")
    label = stripped(F.get("row", F.lit(0)))
    cell = lambda at: F.when(F.col(at) >= 0, F.get("row", F.col(at).cast("int")))
    out = rows.select("doc_id", "table_no", "row_no", first_match(F.upper(label), ROW_TAG).alias("tag"), label.alias("raw_label"), to_float(cell("p")).alias("pressure_psig"), or_null(stripped(cell("t"))).alias("temperature_f"))
    return out.where("tag is not null")


def _clauses(text: Column) -> list[Column]:
    numbers = F.transform(F.regexp_extract_all(text, F.lit(PRESSURE), F.lit(1)), lambda x: x.try_cast("double"))
    return [numbers.alias("pressures"), F.regexp_extract_all(text, F.lit(TEMPERATURE), F.lit(1)).alias("temperatures")]


def title_limits(headers: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(tag, design_pressure_psig, design_temperature_f, raw_header) of header texts (page, text).

    The i-th prefix from the left goes with the i-th pressure and the i-th temperature; what is missing is null.
    With a vocabulary(tag) a prefix, a run of word characters, stands for all its tags; without one, for itself. Later
    pages win.
    """
    text = F.upper(F.col("text"))
    heads = headers.select("page", text.alias("raw_header"))
    if vocabulary is None:
        hits = heads.select("page", F.posexplode(F.regexp_extract_all("raw_header", F.lit(HEADER_PREFIX), F.lit(1))).alias("i", "prefix"))
        hits = hits.groupBy("page", "prefix").agg(F.max("i").alias("i")).withColumn("tag", F.col("prefix"))
    else:
        tags = vocabulary.where("tag is not null").select("tag", F.get(F.split("tag", "-"), F.lit(0)).alias("prefix")).distinct()
        # all prefixes of a header in their order by one pattern; then an equi-join with the vocabulary's
        seen = heads.select("page", F.posexplode(F.regexp_extract_all("raw_header", F.lit(STANDING_PREFIX), F.lit(1))).alias("at", "prefix"))
        at = seen.groupBy("page", "prefix").agg(F.min("at").alias("at")).join(tags.select("prefix").distinct(), "prefix")
        order = Window.partitionBy("page").orderBy("at")
        hits = at.select("page", "prefix", (F.row_number().over(order) - 1).alias("i")).join(tags, "prefix")
    clauses = heads.select("page", "raw_header", *_clauses(F.col("raw_header")))
    found = hits.join(clauses, "page").select("page", "tag", F.struct(F.get("pressures", F.col("i")).alias("design_pressure_psig"), F.get("temperatures", F.col("i")).alias("design_temperature_f"), "raw_header").alias("v"))
    return found.groupBy("tag").agg(F.max_by("v", "page").alias("v")).select("tag", "v.*")


def first_success(reads: DataFrame) -> DataFrame:
    """(page, ord, tag, raw_text) of reading attempts (page, ord, attempt, raw_text).

    The first attempt with a tag decides; without any, the tag is null and the text is the last that isn't empty.
    """
    raw = stripped(F.col("raw_text"))
    tried = reads.select("page", "ord", "attempt", raw.alias("raw"), first_match(F.upper(raw), BOUND_TAG).alias("tag"))
    hit = F.min_by(F.when(F.col("tag").isNotNull(), F.struct("tag", "raw")), F.when(F.col("tag").isNotNull(), F.col("attempt")))
    last = F.max_by("raw", F.when(F.length("raw") > 0, F.col("attempt")))
    out = tried.groupBy("page", "ord").agg(hit.alias("hit"), last.alias("last"))
    return out.select("page", "ord", "hit.tag", F.coalesce("hit.raw", "last", F.lit("")).alias("raw_text"))
