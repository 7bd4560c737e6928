import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tagweave.operators import crossref, detectors, graph
from tagweave.plans import pages as P
from tagweave.schemas import CONTOURS, DETECTIONS, DRAWINGS, PAGES, SYMBOLS
from tagweave.sources import docx, files, sinks

BOX = (0, 0, 10, 10)


def symbols(spark, rows):
    """rows: (page, ord, kind, tag)"""
    return spark.createDataFrame([(p, o, o, k, BOX, t, "", None, None) for p, o, k, t in rows], SYMBOLS)


def test_labels_of_duplicates_and_unresolved(spark):
    nodes = graph.label_nodes(symbols(spark, [(0, 0, "circle", "P-101"), (0, 1, "x", "P-101"), (0, 2, "x", None), (0, 3, "x", "P-101"), (0, 4, "x", None), (1, 0, "x", "P-101")]))
    got = {(r.page, r.ord): (r.label, r.tag) for r in nodes.collect()}
    assert got == {(0, 0): ("P-101", "P-101"), (0, 1): ("P-101 (dup 2)", "P-101"), (0, 2): ("UNLABELED-2", None), (0, 3): ("P-101 (dup 3)", "P-101"), (0, 4): ("UNLABELED-4", None), (1, 0): ("P-101", "P-101")}
    edges = graph.label_edges(spark.createDataFrame([(0, 3, 0), (0, 0, 3), (0, 0, 99)], "page int, a bigint, b bigint"), nodes)
    assert [(r.a, r.b) for r in edges.collect()] == [("P-101", "P-101 (dup 3)")]


def test_composed_pages(spark):
    nodes = graph.label_nodes(symbols(spark, [(0, 0, "circle", "A-10"), (0, 1, "x", None), (1, 0, "x", None), (1, 1, "bowtie", "A-10")]))
    edges = spark.createDataFrame([(0, "A-10", "UNLABELED-1"), (1, "UNLABELED-0", "A-10")], "page int, a string, b string")
    n, e = graph.compose_pages(nodes, edges)
    got = {r.label: (r.page, r.symbol_kind, r.first_page) for r in n.collect()}
    assert got == {"A-10": (1, "bowtie", 0), "UNLABELED-P0-UNLABELED-1": (0, "x", 0), "UNLABELED-P1-UNLABELED-0": (1, "x", 1)}
    assert sorted((r.a, r.b) for r in e.collect()) == [("A-10", "UNLABELED-P0-UNLABELED-1"), ("A-10", "UNLABELED-P1-UNLABELED-0")]


def test_fallback_is_by_page(spark):
    cols = "page int, a bigint, b bigint"
    got = graph.fallback_edges(spark.createDataFrame([(0, 1, 2)], cols), spark.createDataFrame([(0, 5, 6), (1, 7, 8)], cols))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2), (1, 7, 8)]


def test_gates(spark):
    rows = [(0, k, k, kind, (0, 0, w, 10), tag, "", None, o) for k, (kind, w, tag, o) in enumerate([("circle", 151, None, None), ("rectangle", 500, None, None), ("bowtie", 150, "V-12", None), ("odd", 20, None, None), ("gate_valve", 400, None, "valve"), ("odd", 20, "ZZ-1", None)])]
    s = spark.createDataFrame(rows, SYMBOLS)
    ids = lambda df: sorted(r.ord for r in df.collect())
    assert ids(graph.plausible_shapes(s)) == [1, 2, 3, 5]
    assert ids(graph.needs_label_search(s)) == [1]
    assert ids(graph.needs_model_tag(s)) == [3]
    assert ids(graph.needs_model_type(s)) == [3, 5]


def limit(spark, pid, rows):
    d = spark.createDataFrame([("A-10", *pid)], "tag string, design_pressure_psig double, design_temperature_f string")
    s = spark.createDataFrame([("A-10", k, *r) for k, r in enumerate(rows)], "tag string, row_no int, pressure_psig double, temperature_f string")
    return [r.severity for r in crossref.ordered(crossref.limit_findings(d, s)).collect()]


@pytest.mark.parametrize(
    "pid,rows,want",
    [
        ((275.0, "100"), [(275.0, "100")], []), ((300.0, "3/75"), [(300.0, "375")], []), ((200.0, "100"), [(275.0, "100")], ["ERROR"]), ((300.0, "250"), [(300.0, "375"), (300.0, "250")], []),
        ((300.0, "100"), [], []), ((127.8, "100"), [(128.3, "100")], []), ((0.0, "100"), [(300.0, "100")], ["ERROR"]), ((-14.3, "100"), [(-14.7, "100")], []), ((300.0, "125"), [(300.0, "1-25")], ["WARNING"]),
        ((None, "100"), [(275.0, "100")], []), ((1.0, "5"), [(None, None)], ["ERROR", "WARNING"]),
    ],
)
def test_limits(spark, pid, rows, want):
    assert limit(spark, pid, rows) == want


def test_golden_report(spark, tmp_path):
    """A small graph file with no procedure, and its report line by line."""
    node = lambda label, k, tag, raw, kind, of, box: {"shape_id": k, "tag": tag, "ocr_raw_text": raw, "symbol_kind": kind, "component_type": of, "bbox": box, "tag_confidence": "ocr_matched" if tag else "unresolved", "id": label}
    graph = [
        node("V-101", 0, "V-101", "V-101", "bowtie", "valve", [10, 20, 30, 40]), node("UNLABELED-P0-UNLABELED-1", 1, None, "it's", "circle", "instrument", [1, 2, 3, 4]), node("V-101 (dup 2)", 2, "V-101", "V-101", "bowtie", "valve", [50, 20, 30, 40]),
        node("FT-7", 3, "FT-7", "FT-7", "circle", "flow_transmitter", [90, 20, 30, 30]), node("UNLABELED-P0-UNLABELED-4", 4, None, "", "rectangle", "tank", [5, 6, 7, 8]), node("A-1", 5, "A-1", "A-1", "rectangle", "tank", [0, 0, 9, 9]),
    ]
    (tmp_path / "g.json").write_text(json.dumps({"directed": False, "multigraph": False, "graph": {}, "nodes": graph, "edges": [{"source": "V-101", "target": "FT-7"}, {"source": "FT-7", "target": "V-101"}]}, indent=1))
    nodes, edges = files.node_link_graph(spark, f"{tmp_path}/g.json")
    assert nodes.count() == 6 and [tuple(r) for r in edges.collect()] == [("FT-7", "V-101")]
    none = lambda cols: spark.createDataFrame([], cols)
    found = crossref.graph_findings(nodes, edges, none("tag string"), none("tag string, declared_type string"), none("a string, b string"))
    want = [
        ("WARNING", "DUPLICATE_TAG", "2 distinct P&ID symbols all resolved to tag V-101 (V-101, V-101 (dup 2)) — likely an OCR/extraction ambiguity, or a genuine duplicate tag on the drawing; verify manually."),
        ("WARNING", "UNRESOLVED_TAG", "Detected circle symbol at bbox=[1, 2, 3, 4] could not be OCR-matched to a tag (raw text: \"it's\")."),
        ("WARNING", "UNRESOLVED_TAG", "Detected rectangle symbol at bbox=[5, 6, 7, 8] could not be OCR-matched to a tag (raw text: '')."),
        ("INFO", "MISSING_IN_SOP", "P&ID component A-1 is not referenced anywhere in the SOP."), ("INFO", "MISSING_IN_SOP", "P&ID component FT-7 is not referenced anywhere in the SOP."),
        ("INFO", "MISSING_IN_SOP", "P&ID component V-101 is not referenced anywhere in the SOP."),
    ]
    assert [tuple(r) for r in crossref.public(crossref.ordered(found)).collect()] == want
    log = ["P&ID <-> SOP Cross-Reference Report", "Summary: 0 error(s), 3 warning(s), 3 info", "", *[f"[{s}] ({c}) {m}" for s, c, m in want]]
    assert [r.value for r in sinks.findings_log(found).collect()] == log
    sinks.write_report(found, str(tmp_path))
    sinks.write_graph(nodes, edges, str(tmp_path))
    text = lambda name: "\n".join(r.value for r in spark.read.text(f"{tmp_path}/{name}").collect())
    assert [(x["severity"], x["category"], x["message"]) for x in json.loads(text("report_json"))] == want
    again = json.loads(text("graph_json"))
    assert again == json.loads(sinks.graph_json(nodes, edges).first().value) and again["nodes"] == graph
    # nothing at all is a document too
    sinks.write_graph(nodes.limit(0), edges.limit(0), str(tmp_path))
    sinks.write_report(found.limit(0), str(tmp_path))
    assert json.loads(text("graph_json"))["nodes"] == [] and json.loads(text("report_json")) == []


PAGE = (0, 1300.0, 700.0, 72, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))
PROCEDURE = "Start\nOpen V-101 valve.\npump T-101 is filled.\nP-101 pump connects to nothing. P-101 connects to V-101.\nFT-101 transmitter. FT-101 flows to T-101.\nCheck PSV-201."


def scene(spark):
    """Six symbols as contours with their readings, and three pipes as drawings."""
    boxes = [(90, 220, 120, 160, 4, 0.99, 19200.0), (355, 255, 90, 90, 12, 0.99, 6300.0), (605, 270, 90, 60, 6, 0.6, 2500.0), (865, 265, 70, 70, 12, 0.99, 3800.0), (1105, 270, 90, 60, 6, 0.6, 2500.0), (670, 100, 60, 50, 4, 0.99, 3000.0)]
    contours = []
    for k, (x, y, w, h, n, solid, area) in enumerate(boxes):
        perimeter = 2.0 * (w + h) if n == 4 else (12.566370614359172 * area / 0.9) ** 0.5 if n == 12 else 400.0
        contours.append((0, k, -1, area, perimeter, n, area / solid, x, y, w, h))
    contours.append((0, 6, 1, 1500.0, 150.0, 3, 1500.0, 380, 280, 40, 40))
    contours.append((0, 7, -1, 500.0, 90.0, 4, 500.0, 0, 0, 20, 25))
    tags = ["T-101", "P-101", "V-101", "FT-101", "V-102", ""]
    reads = spark.createDataFrame([(0, k, a, t if a else "") for k, t in enumerate(tags) for a in range(2)], "page int, shape_id bigint, attempt int, raw_text string")
    pipe = lambda k, x0, x1: (0, k, "s", [("l", [(x0, 300.0), (x1, 300.0)])], (x0, 299.0, x1, 301.0))
    drawings = spark.createDataFrame([pipe(0, 150.0, 400.0), pipe(1, 400.0, 650.0), pipe(2, 650.0, 900.0), pipe(3, 0.0, 900.0)], DRAWINGS)
    return P.Primitives(spark.createDataFrame([PAGE], PAGES), drawings=drawings, contours=spark.createDataFrame(contours, CONTOURS), reads=reads)


def test_a_whole_run(spark, tmp_path):
    p = scene(spark)
    nodes, edges = P.whole_graph(p)
    assert {r.label: r.component_type for r in nodes.collect()} == {"FT-101": "flow_transmitter", "UNLABELED-P0-UNLABELED-5": "tank", "V-101": "valve", "V-102": "valve", "P-101": "pump", "T-101": "tank"}
    assert sorted((r.a, r.b) for r in edges.collect()) == [("FT-101", "V-101"), ("P-101", "T-101"), ("P-101", "V-101")]
    sop = spark.createDataFrame([("d", PROCEDURE, PROCEDURE.split("\n"), [[["", "Pressure"], ["T-101 tank", "100"]]])], "doc_id string, full_text string, paragraphs array<string>, tables array<array<array<string>>>")
    heads = spark.createDataFrame([(0, "T-101 DESIGN: 200 PSIG @ 10F")], "page int, text string")
    found = P.run(p, sop, heads, str(tmp_path)).collect()
    assert [(r.severity, r.category, r.key) for r in found] == [
        ("ERROR", "MISSING_IN_PID", "PSV-201"), ("ERROR", "CONNECTION_MISMATCH", "FT-101"), ("WARNING", "TYPE_MISMATCH", "T-101"), ("WARNING", "UNRESOLVED_TAG", None),
        ("INFO", "MISSING_IN_SOP", "V-102"), ("ERROR", "DESIGN_LIMIT_MISMATCH", "T-101"), ("WARNING", "DESIGN_LIMIT_MISMATCH", "T-101"),
    ]
    text = lambda name: "\n".join(r.value for r in spark.read.text(f"{tmp_path}/{name}").collect())
    assert len(json.loads(text("report_json"))) == 7 and "Summary: 3 error(s), 3 warning(s), 1 info" in text("report_log")
    again, links = files.node_link_graph(spark, f"{tmp_path}/graph_json")
    assert again.count() == 6 and links.count() == 3
    from xml.etree import ElementTree

    assert len(ElementTree.fromstring(text("graphml").encode()).findall(".//{*}node")) == 6
    with pytest.raises(ValueError):
        P.one_page(p, 4)


def test_no_findings(spark):
    empty = spark.createDataFrame([], "severity string, category string, message string, pass_no int, severity_rank int, category_rank int, key string, key2 string, place bigint")
    assert [r.value for r in sinks.findings_log(empty).collect()][-1] == "No discrepancies found."
    assert sinks.findings_json(empty).first().value == "[]"


def test_vector_signatures(spark):
    loop = [("c", [(0.0, 0.0), (1.0, 1.0)]), ("c", [(1.0, 1.0), (0.2, 0.2)])]
    lines = lambda n: [("l", [(0.0, 0.0), (1.0, 1.0)])] * n
    rows = [
        (0, 0, "s", loop, (10.0, 10.0, 26.0, 26.0)), (0, 1, "s", loop[:1], (10.0, 10.0, 26.0, 26.0)), (0, 2, "f", loop, (10.0, 10.0, 26.0, 26.0)), (0, 3, "s", [], (10.0, 10.0, 26.0, 26.0)),
        (0, 4, "fs", lines(24), (0.0, 0.0, 10.0, 11.0)), (0, 5, "s", lines(12), (0.0, 0.0, 100.0, 10.0)), (0, 6, "s", lines(70), (0.0, 0.0, 100.0, 20.0)), (0, 7, "s", lines(50), (0.0, 0.0, 10.0, 60.0)),
        (0, 8, "s", lines(1), (0.0, 0.0, 9.0, 1.0)), (0, 9, "s", lines(1), (0.0, 0.0, 400.0, 1.0)), (0, 10, "s", loop, (5.0, 5.0, 5.0, 21.0)),
    ]
    rows += [(0, 20 + k, "s", [("c", [(0.0, 0.0)])] * 2, (50.0 + 8 * k, 50.0, 54.0 + 8 * k, 55.0)) for k in range(9)]
    d, pages = spark.createDataFrame(rows, DRAWINGS), spark.createDataFrame([(0, 600.0, 500.0, 144, (0.0, 1.0, -1.0, 0.0, 500.0, 0.0))], PAGES)
    ids = lambda df, c="ord": [r[c] for r in df.orderBy(c).collect()]
    assert ids(detectors.circles(d, pages)) == [0] and ids(detectors.valves(d, pages)) == [4, 5] and ids(detectors.vessels(d, pages)) == [6, 7]
    assert ids(detectors.segments(d, pages), "seg_id") == [8, 10]
    r = detectors.circles(d, pages).first()
    assert tuple(r.bbox) == (948, 20, 32, 32) and tuple(r.center) == (964, 36)  # turned by a quarter, at 2 pixels a point
    c = detectors.coils(d).collect()
    assert [(x.arcs, x.x0, x.x1) for x in c] == [(9, 50.0, 118.0)]


def test_detector_shapes_and_model_replies_fill_gaps_only(spark):
    det = spark.createDataFrame([(0, 0, (10, 10, 50, 50), "Gate Valve", 0.9, 0, 0), (0, 1, (100, 100, 130, 130), "Arrow", 0.9, 0, 0), (0, 2, (200, 10, 250, 60), "Rotameter", 0.9, 0, 0)], f"{DETECTIONS}, tile_x int, tile_y int")
    reads = spark.createDataFrame([(0, 0, 0, "MV-701")], "page int, shape_id bigint, attempt int, raw_text string")
    replies = spark.createDataFrame([(0, 0, "PI-1"), (0, 2, "it reads FI 22")], "page int, shape_id bigint, reply string")
    p = P.Primitives(spark.createDataFrame([(0, 600.0, 600.0, 72, PAGE[4])], PAGES), detections=det, reads=reads, model_tags=replies, model_types=spark.createDataFrame([(0, 1, "equipment, pump")], "page int, shape_id bigint, reply string"))
    got = {r.shape_id: (r.tag, r.component_type, r.tag_confidence) for r in P.page_graphs(p)[0].collect()}
    assert got == {0: ("MV-701", "valve", "ocr_matched"), 1: (None, "unknown", "unresolved"), 2: ("FI 22", "flow_indicator", "llm_assisted")}


def docx_file(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_procedure_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, extra="": f"<w:tc>{extra}{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('')}{cell(' Pressure ')}</w:tr><w:tr>{cell('F-715 x', '<w:tcPr><w:gridSpan w:val=&quot;1&quot;/></w:tcPr>'.replace('&quot;', chr(34)))}{cell('275')}</w:tr></w:tbl>"
    docx_file(tmp_path / "a.docx", p(" First V-101 ") + p("  ") + table + p("Second"))
    docx_file(tmp_path / "b.docx", p("Other"))
    docx.register(spark)
    rows = spark.read.format("procedure_docx").load(str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.full_text, r.paragraphs, r.tables) for r in rows] == [("First V-101\nSecond", ["First V-101", "Second"], [[["", "Pressure"], ["F-715 x", "275"]]]), ("Other", ["Other"], [])]
    assert sorted(map(tuple, docx.procedures(spark, str(tmp_path)).select("full_text", "paragraphs", "tables").collect())) == sorted((r.full_text, r.paragraphs, r.tables) for r in rows)
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no procedure"):
        docx.procedures(spark, str(tmp_path / "empty"))
    with pytest.raises(FileNotFoundError):
        docx.parse_docx(str(tmp_path / "none.docx"))
    with pytest.raises(Exception, match="no procedure"):
        spark.read.format("procedure_docx").load(str(tmp_path / "none.docx")).collect()


def test_places_are_ordered(spark):
    n = spark.createDataFrame([(1, 0), (0, 7)], "first_page int, first_ord bigint")
    assert [r.first_page for r in P.place(n).orderBy(F.col("place")).collect()] == [0, 1]
