"""Sinks: graphs as node-link JSON and GraphML, findings as JSON and as a text log, merged data sets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scalars import listed
from ..functions.vocabulary import COARSE3
from ..operators.crossref import KEYS, severity_counts

_ATTRIBUTES = ("shape_id", "tag", "ocr_raw_text", "symbol_kind", "component_type", "bbox", "tag_confidence")
_GRAPHML = "http://graphml.graphdrawing.org/xmlns"


def _box(bbox: Column) -> Column:
    return F.array(*[bbox[k] for k in "xywh"])


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, ``value``: the node-link document of nodes (in order of ``place``) and edges."""
    node = F.struct(*[(_box(F.col("bbox")) if a == "bbox" else F.col(a)).alias(a) for a in _ATTRIBUTES], F.col("label").alias("id"))
    ns = nodes.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", node.alias("n")))), lambda x: x["n"]).alias("nodes"))
    es = edges.agg(F.sort_array(F.collect_list(F.struct(F.col("a").alias("source"), F.col("b").alias("target")))).alias("edges"))
    whole = F.struct(F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), F.create_map().cast("map<string,string>").alias("graph"), "nodes", "edges")
    return ns.crossJoin(es).select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def _xml(text: Column) -> Column:
    for raw, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(by))
    return text


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, place, value): the lines of a GraphML document; nulls are empty, boxes are lists as text."""
    spark = nodes.sparkSession
    head = [f'<?xml version="1.0" encoding="utf-8"?><graphml xmlns="{_GRAPHML}">']
    head += [f'<key id="d{k}" for="node" attr.name="{a}" attr.type="{"long" if a == "shape_id" else "string"}"/>' for k, a in enumerate(_ATTRIBUTES)]
    head += ['<graph edgedefault="undirected">']
    lines = spark.createDataFrame([(0, k, v) for k, v in enumerate(head)] + [(3, 0, "</graph></graphml>")], "part int, place bigint, value string")
    data = [F.concat(F.lit(f'<data key="d{k}">'), _xml(F.coalesce(listed(_box(F.col("bbox"))) if a == "bbox" else F.col(a).cast("string"), F.lit(""))), F.lit("</data>")) for k, a in enumerate(_ATTRIBUTES)]
    node = F.concat(F.lit('<node id="'), _xml(F.col("label")), F.lit('">'), *data, F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), _xml(F.col("a")), F.lit('" target="'), _xml(F.col("b")), F.lit('"/>'))
    return lines.unionByName(nodes.select(F.lit(1).alias("part"), "place", node.alias("value"))).unionByName(edges.select(F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("place"), edge.alias("value")))


def findings_json(findings: DataFrame) -> DataFrame:
    """One row, ``value``: the findings in order, as a JSON array."""
    item = F.struct(*[F.col(k) for k in KEYS], F.struct("severity", "category", "message").alias("f"))
    return findings.agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["f"])).alias("value"))


def findings_log(findings: DataFrame) -> DataFrame:
    """(line, value): title, summary, blank line, then a line for each finding in order, or one that there is none."""
    counts = severity_counts(findings)
    summary = F.format_string("Summary: %d error(s), %d warning(s), %d info", "errors", "warnings", "infos")
    none = F.col("errors") + F.col("warnings") + F.col("infos") == 0
    top = counts.select(F.posexplode(F.filter(F.array(F.lit("P&ID <-> SOP Cross-Reference Report"), summary, F.lit(""), F.when(none, "No discrepancies found.")), lambda x: x.isNotNull())).alias("line", "value"))
    top = top.select(F.lit(0).alias("part"), F.col("line").cast("bigint").alias("line"), "value", *[F.lit(None).alias(k) for k in KEYS])
    body = findings.select(F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("line"), F.concat(F.lit("["), "severity", F.lit("] ("), "category", F.lit(") "), "message").alias("value"), *KEYS)
    return top.unionByName(body).orderBy("part", "line", *KEYS).select("value")


def write_lines(df: DataFrame, path: str) -> None:
    """One text file of a DataFrame ``value`` whose order is its own."""
    df.select("value").coalesce(1).write.mode("overwrite").text(path)


def _listing(rows: DataFrame, part: int, order: list[str], value: Column) -> DataFrame:
    """(part, order.., value) of rows as the elements of a JSON list, a line each; a comma before all but the first."""
    first = rows.agg(F.min(F.struct(*order)).alias("first"))
    comma = F.when(F.struct(*order) == F.col("first"), "").otherwise(",")
    return rows.crossJoin(F.broadcast(first)).select(F.lit(part).alias("part"), *order, F.concat(comma, value).alias("value"))


def graph_json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, place, label, value): the document of ``graph_json`` in lines, one for each node and edge, so that none outgrows a value."""
    spark = nodes.sparkSession
    frame = [(0, '{"directed":false,"multigraph":false,"graph":{},"nodes":['), (2, '],"edges":['), (4, "]}")]
    lines = spark.createDataFrame([(k, None, None, v) for k, v in frame], "part int, place bigint, label string, value string")
    node = F.to_json(F.struct(*[(_box(F.col("bbox")) if a == "bbox" else F.col(a)).alias(a) for a in _ATTRIBUTES], F.col("label").alias("id")), {"ignoreNullFields": "false"})
    ends = edges.select(F.lit(0).cast("bigint").alias("place"), F.to_json(F.struct(F.col("a").alias("source"), F.col("b").alias("target"))).alias("label"))
    return lines.unionByName(_listing(nodes.withColumn("place", F.col("place").cast("bigint")), 1, ["place", "label"], node)).unionByName(_listing(ends, 3, ["place", "label"], F.col("label")))


def findings_json_lines(findings: DataFrame) -> DataFrame:
    """(part, keys.., message, value): the array of ``findings_json`` in lines, one for each finding."""
    spark = findings.sparkSession
    item = F.to_json(F.struct("severity", "category", "message"))
    rows = _listing(findings, 1, [*KEYS, "message"], item)
    frame = spark.createDataFrame([(0, "["), (2, "]")], "part int, value string")
    return rows.unionByName(frame, allowMissingColumns=True)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    write_lines(graph_json_lines(nodes, edges).orderBy("part", "place", "label"), f"{folder}/graph_json")
    write_lines(graphml_lines(nodes, edges).orderBy("part", "place", "value"), f"{folder}/graphml")


def write_report(findings: DataFrame, folder: str) -> None:
    write_lines(findings_json_lines(findings).orderBy("part", *KEYS, "message"), f"{folder}/report_json")
    write_lines(findings_log(findings), f"{folder}/report_log")


def write_score(score: DataFrame, folder: str) -> None:
    write_lines(score.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")), folder)


def _file_system(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _write(path: str, content: bytes) -> None:
    system, at = _file_system(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(content)


def _files_of(folder: str):
    """Writes a partition's rows (split, name, path, suffix, labels) as files of a data set."""

    def run(rows: Iterable[Row]) -> None:
        for r in rows:
            system, at = _file_system(r["path"])
            with system.open_input_stream(at) as f:
                _write(f"{folder}/images/{r['split']}/{r['name']}{r['suffix']}", f.read())
            _write(f"{folder}/labels/{r['split']}/{r['name']}.txt", (r["labels"] + "\n").encode())

    return run


def write_dataset(merged: DataFrame, folder: str, names: Sequence[str] = COARSE3) -> None:
    """A detection data set: images/<split>/<name>.<suffix>, labels/<split>/<name>.txt and data.yaml.

    merged(split, name, path, labels, ..) has only images with a box, so none is written without. Each task writes
    the files of its rows, over those that are there, so it may be run again.
    """
    suffix = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    merged.select("split", "name", "path", suffix.alias("suffix"), "labels").foreachPartition(_files_of(folder))
    splits = sorted(r["split"] for r in merged.select("split").distinct().collect())
    lines = [f"path: {folder}", *[f"{s}: images/{s}" for s in splits], f"nc: {len(names)}", f"names: [{', '.join(names)}]"]
    _write(f"{folder}/data.yaml", ("\n".join(lines) + "\n").encode())
