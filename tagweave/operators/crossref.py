"""Cross-references between graph, facts and limits, as findings.

Findings come with sort keys: pass_no, severity rank, category rank, and the keys within a category; ``ordered``
sorts by them, ``public`` leaves severity, category and message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

RANK = {"ERROR": 0, "WARNING": 1, "INFO": 2}
TOLERANCE = 0.5
KEYS = ["pass_no", "severity_rank", "category_rank", "key", "key2", "place"]


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _finding(df: DataFrame, severity: str, category: str, rank: int, message: Column, key: Column | None = None, key2: Column | None = None, place: Column | None = None, pass_no: int = 0) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"), F.lit(pass_no).alias("pass_no"),
        F.lit(RANK[severity] if pass_no == 0 else 0).alias("severity_rank"), F.lit(rank).alias("category_rank"),
        (none if key is None else key).cast("string").alias("key"), (none if key2 is None else key2).cast("string").alias("key2"), (none if place is None else place).cast("bigint").alias("place"),
    )


def tagged(nodes: DataFrame) -> DataFrame:
    return nodes.where("tag is not null and tag <> ''")


def missing_in_graph(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Referenced tags that no node has."""
    return refs.select("tag").distinct().join(tagged(nodes).select("tag"), "tag", "left_anti")


def missing_in_text(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Tags of nodes that aren't referenced."""
    return tagged(nodes).select("tag").distinct().join(refs.select("tag"), "tag", "left_anti")


def duplicate_tags(nodes: DataFrame) -> DataFrame:
    """(tag, n, labels): tags of two and more nodes, labels in the nodes' order (``place``)."""
    per = tagged(nodes).groupBy("tag").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("place", "label"))).alias("all")).where("n > 1")
    return per.select("tag", "n", F.array_join(F.col("all.label"), ", ").alias("labels"))


def type_mismatches(types: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tag, declared_type, actual): declared types that none of the tag's nodes has. actual: theirs, joined by /."""
    actual = tagged(nodes).groupBy("tag").agg(F.sort_array(F.collect_set(S.coarse6(F.col("component_type")))).alias("actuals"))
    on = types.join(actual, "tag").where((F.size("actuals") > 0) & ~F.array_contains("actuals", F.col("declared_type")))
    return on.select("tag", "declared_type", F.array_join("actuals", "/").alias("actual"))


def connection_mismatches(connections: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): stated connections whose tags both have nodes, none of them joined by an edge."""
    tags = tagged(nodes).select("tag").distinct()
    known = connections.join(tags.withColumnRenamed("tag", "a"), "a", "left_semi").join(tags.withColumnRenamed("tag", "b"), "b", "left_semi")
    # from the edges' side, which are few to a node, instead of all pairs of duplicates
    name = lambda c: tagged(nodes).select(F.col("label").alias(c), F.col("tag").alias(f"{c}_tag"))
    drawn = edges.select("a", "b").join(name("a"), "a").join(name("b"), "b")
    drawn = drawn.select(F.least("a_tag", "b_tag").alias("a"), F.greatest("a_tag", "b_tag").alias("b")).distinct()
    return known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(drawn, ["a", "b"], "left_anti")


def unresolved(nodes: DataFrame) -> DataFrame:
    return nodes.where("tag is null")


def graph_findings(nodes: DataFrame, edges: DataFrame, refs: DataFrame, types: DataFrame, connections: DataFrame) -> DataFrame:
    """All findings between a graph and a procedure. nodes have ``place``, their order."""
    tag = F.col("tag")
    gone = _finding(missing_in_graph(refs, nodes), "ERROR", "MISSING_IN_PID", 0, _text("SOP references ", tag, ", but no matching component was detected in the P&ID."), tag)
    extra = _finding(missing_in_text(nodes, refs), "INFO", "MISSING_IN_SOP", 1, _text("P&ID component ", tag, " is not referenced anywhere in the SOP."), tag)
    dup = _finding(duplicate_tags(nodes), "WARNING", "DUPLICATE_TAG", 2, _text(F.col("n").cast("string"), " distinct P&ID symbols all resolved to tag ", tag, " (", F.col("labels"), ") — likely an OCR/extraction ambiguity, or a genuine duplicate tag on the drawing; verify manually."), tag)
    kinds = _finding(type_mismatches(types, nodes), "WARNING", "TYPE_MISMATCH", 3, _text("SOP describes ", tag, " as a ", F.col("declared_type"), ", but the P&ID symbol(s) were classified as ", F.col("actual"), "."), tag)
    links = _finding(connection_mismatches(connections, nodes, edges), "ERROR", "CONNECTION_MISMATCH", 4, _text("SOP states ", F.col("a"), " connects to ", F.col("b"), ", but no such connection was detected in the P&ID."), F.col("a"), F.col("b"))
    box = S.listed(F.array("bbox.x", "bbox.y", "bbox.w", "bbox.h"))
    blank = _finding(unresolved(nodes), "WARNING", "UNRESOLVED_TAG", 5, _text("Detected ", S.shown(F.col("symbol_kind")), " symbol at bbox=", box, " could not be OCR-matched to a tag (raw text: ", S.quoted(F.col("ocr_raw_text")), ")."), place=F.col("place"))
    return gone.unionByName(extra).unionByName(dup).unionByName(kinds).unionByName(links).unionByName(blank)


def pressure_agrees(stated: Column, listed: Column) -> Column:
    """One procedure row against the diagram, which may say nothing; a row without pressure doesn't agree."""
    return stated.isNull() | F.coalesce(F.round(F.abs(listed - stated), 6) <= TOLERANCE, F.lit(False))


def temperature_agrees(stated: Column, listed: Column) -> Column:
    """The same digits, and both or neither a range."""
    same = S.digits(listed).eqNullSafe(S.digits(stated)) & (S.is_range(listed) == S.is_range(stated))
    return stated.isNull() | (listed.isNotNull() & same)


def limit_checks(diagram: DataFrame, procedure: DataFrame) -> DataFrame:
    """(tag, stated pressure and temperature, pressure_ok, temperature_ok, listed rows) of tags that both have.

    diagram(tag, design_pressure_psig, design_temperature_f), one row a tag; procedure(tag, pressure_psig,
    temperature_f, ...), some. A limit is right if any of the rows agrees.
    """
    order = [c for c in ("doc_id", "table_no", "row_no") if c in procedure.columns]
    p, t = F.col("design_pressure_psig"), F.col("design_temperature_f")
    shown = _text(S.shown(F.col("pressure_psig"), True), " psig / ", S.shown(F.col("temperature_f")), "°F")
    on = diagram.join(procedure, "tag").groupBy("tag").agg(
        F.first(p).alias("p"), F.first(t).alias("t"), F.bool_or(pressure_agrees(p, F.col("pressure_psig"))).alias("pressure_ok"),
        F.bool_or(temperature_agrees(t, F.col("temperature_f"))).alias("temperature_ok"), F.sort_array(F.collect_list(F.struct(*order, shown.alias("shown")))).alias("rows"),
    )
    return on.select("tag", F.col("p").alias("design_pressure_psig"), F.col("t").alias("design_temperature_f"), "pressure_ok", "temperature_ok", F.array_join(F.col("rows.shown"), ", ").alias("listed"))


def limit_findings(diagram: DataFrame, procedure: DataFrame) -> DataFrame:
    """Design limits that diagram and procedure state differently; they come after the graph's findings, by tag."""
    checked, tag = limit_checks(diagram, procedure), F.col("tag")
    p = _finding(checked.where("not pressure_ok"), "ERROR", "DESIGN_LIMIT_MISMATCH", 0, _text(tag, ": P&ID states design pressure ", S.shown(F.col("design_pressure_psig"), True), " psig, SOP table lists ", F.col("listed"), "."), tag, F.lit("0"), pass_no=1)
    t = _finding(checked.where("not temperature_ok"), "WARNING", "DESIGN_LIMIT_MISMATCH", 0, _text(tag, ": P&ID states design temperature ", S.shown(F.col("design_temperature_f")), "°F, SOP table lists ", F.col("listed"), " (temperature OCR is lower-confidence — verify manually)."), tag, F.lit("1"), pass_no=1)
    return p.unionByName(t)


def ordered(findings: DataFrame, by_severity_only: bool = False) -> DataFrame:
    """In the order of a report; ``by_severity_only`` ranks limit findings among the others."""
    if by_severity_only:
        rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
        return findings.orderBy(rank, *KEYS)
    return findings.orderBy(*KEYS)


def public(findings: DataFrame) -> DataFrame:
    return findings.select("severity", "category", "message")


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("ERROR", "errors"), ("WARNING", "warnings"), ("INFO", "infos"))])
