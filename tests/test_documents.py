"""Several documents, adapters with stand-ins for their libraries, data sets as files, and the command line."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tagweave.operators import datasets, scoring, spatial
from tagweave.plans import pages as P
from tagweave.sources import adapters, raster, sinks

from .test_graph import PROCEDURE, docx_file, scene

#: A page is {"w", "h", "turned", "drawings"}; a picture is its size and the box that was cut out of it.
FITZ = """
import json
class Point:
    def __init__(self, x, y): self.x, self.y = x, y
class Rect:
    def __init__(self, x0, y0, x1, y1): self.x0, self.y0, self.x1, self.y1 = x0, y0, x1, y1
    width = property(lambda s: s.x1 - s.x0)
    height = property(lambda s: s.y1 - s.y0)
class Matrix:
    def __init__(self, *v): self.a, self.b, self.c, self.d, self.e, self.f = v
class Pixmap:
    def __init__(self, w, h): self.width, self.height = w, h
    def tobytes(self, kind): return json.dumps({"w": self.width, "h": self.height, "box": None, "kind": kind}).encode()
class Page:
    def __init__(self, p): self.p = p
    rect = property(lambda s: Rect(0, 0, s.p["w"], s.p["h"]))
    rotation_matrix = property(lambda s: Matrix(0, 1, -1, 0, s.p["h"], 0) if s.p.get("turned") else Matrix(1, 0, 0, 1, 0, 0))
    def get_drawings(self): return [{"type": "s", "items": [("l", Point(*d[:2]), Point(*d[2:]))], "rect": Rect(*d)} for d in self.p.get("drawings", [])]
    def get_pixmap(self, dpi): return Pixmap(self.p["w"] * dpi // 72, self.p["h"] * dpi // 72)
class open:
    def __init__(self, stream, filetype): self.pages = [Page(p) for p in json.loads(bytes(stream))]
    def __enter__(self): return self
    def __exit__(self, *x): pass
    def __len__(self): return len(self.pages)
    def __iter__(self): return iter(self.pages)
"""
IMAGE = """
import json
class Picture:
    def __init__(self, d): self.d = d; self.width, self.height = d["w"], d["h"]
    def crop(self, box): return Picture({"w": box[2] - box[0], "h": box[3] - box[1], "box": list(box)})
    def resize(self, size): return Picture(self.d | {"w": size[0], "h": size[1]})
    def save(self, into, kind): into.write(json.dumps(self.d | {"kind": kind}).encode())
def open(f): return Picture(json.loads(f.read()))
"""
ULTRALYTICS = """
class V(list):
    def tolist(self): return list(self)
class Box:
    def __init__(self, c, k, p): self.xyxy, self.cls, self.conf = [V(c)], [k], [p]
class Result:
    names = {0: "Gate Valve", 1: "Pump"}
    def __init__(self, boxes): self.boxes = boxes
class YOLO:
    def __init__(self, weights): self.weights = weights
    def predict(self, picture, conf, verbose): return [Result([Box((10, 20, 40, 60), 0, 0.9), Box((11, 20, 41, 60), 0, 0.8), Box((100, 100, 160, 150), 1, 0.7)])]
"""


@pytest.fixture(scope="module")
def stand_ins(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("standins") / "standins.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in {"fitz.py": FITZ, "PIL/__init__.py": "", "PIL/Image.py": IMAGE, "ultralytics.py": ULTRALYTICS, "pytesseract.py": TESSERACT}.items():
            z.writestr(name, text)
    spark.sparkContext.addPyFile(str(path))


TESSERACT = """
class Output: DICT = "dict"
def image_to_data(picture, output_type): return {"text": ["E-101", ""], "left": [picture.width, 0], "top": [1, 0], "width": [30, 0], "height": [10, 0], "conf": [90, -1]}
"""


def pdf(spark, **docs):
    return spark.createDataFrame([(k, bytearray(json.dumps(v).encode())) for k, v in docs.items()], "path string, content binary")


def test_pages_of_two_files_are_told_apart(spark, stand_ins):
    files = pdf(spark, a=[{"w": 600, "h": 400, "drawings": [(0, 0, 20, 1)]}, {"w": 300, "h": 200, "turned": True}], b=[{"w": 100, "h": 100, "drawings": [(5, 5, 50, 6), (1, 1, 2, 2)]}])
    got = {tuple(r.page): (r.width, r.height, r.dpi, r.matrix.b) for r in adapters.pdf_pages(files, 144).collect()}
    assert got == {("a", 0): (600.0, 400.0, 144, 0.0), ("a", 1): (300.0, 200.0, 144, 1.0), ("b", 0): (100.0, 100.0, 144, 0.0)}
    drawn = sorted((tuple(r.page), r.draw_id, r.type, len(r["items"][0].pts)) for r in adapters.pdf_drawings(files).collect())
    assert drawn == [(("a", 0), 0, "s", 2), (("b", 0), 0, "s", 2), (("b", 0), 1, "s", 2)]
    images = adapters.pdf_images(files, 144)
    assert {tuple(r.page): (r.width, r.height) for r in images.collect()} == {("a", 0): (1200, 800), ("a", 1): (600, 400), ("b", 0): (200, 200)}
    with pytest.raises(Exception, match="no pages: c"):
        adapters.pdf_pages(pdf(spark, c=[])).collect()


def test_crops_and_tiles(spark, stand_ins):
    images = adapters.pdf_images(pdf(spark, a=[{"w": 900, "h": 500}], b=[{"w": 100, "h": 100}]), 72)
    shapes = spark.createDataFrame([(("a", 0), 7, (10, 100, 50, 30)), (("b", 0), 7, (90, 90, 5, 5)), (("b", 0), 8, (500, 500, 5, 5))], "page struct<doc_id: string, page: int>, shape_id bigint, bbox struct<x: int, y: int, w: int, h: int>")
    crops = {(r.page.doc_id, r.ord): json.loads(bytes(r.png)) for r in adapters.label_crops(images, shapes).collect()}
    assert crops == {("a", 7): {"w": 400, "h": 520, "box": [0, 80, 100, 210], "kind": "PNG"}, ("b", 7): {"w": 200, "h": 120, "box": [50, 70, 100, 100], "kind": "PNG"}}
    tiles = {(r.page.doc_id, r.tile_x, r.tile_y): json.loads(bytes(r.png))["box"] for r in adapters.page_tiles(images).collect()}
    assert tiles == {("a", 0, 0): [0, 0, 640, 500], ("a", 260, 0): [260, 0, 900, 500], ("b", 0, 0): [0, 0, 100, 100]}
    assert "FT-101" in adapters.READ_PROMPT and "valve, instrument, equipment" in adapters.TYPE_PROMPT


def test_detections_of_tiles_become_shapes(spark, stand_ins, tmp_path):
    with pytest.raises(FileNotFoundError):
        adapters.detections(spark.createDataFrame([], "page int, tile_x int, tile_y int, png binary"), str(tmp_path / "none.pt"))
    (tmp_path / "w.pt").write_bytes(b"x")
    images = adapters.pdf_images(pdf(spark, a=[{"w": 900, "h": 500}], b=[{"w": 100, "h": 100}]), 72)
    found = adapters.detections(adapters.page_tiles(images), str(tmp_path / "w.pt"))
    rows = found.collect()
    assert len(rows) == 9 and len({(r.page.doc_id, r.ord) for r in rows}) == 9
    shapes = spatial.detected_shapes(found, images.select("page", "width", "height")).collect()
    # on the tiled page the lesser of two that overlap goes; the small page is taken as it is
    assert sorted((r.page.doc_id, r.kind, r.bbox.x) for r in shapes) == [("a", "gate_valve", 10), ("a", "gate_valve", 270), ("a", "pump", 100), ("a", "pump", 360), ("b", "gate_valve", 10), ("b", "gate_valve", 11), ("b", "pump", 100)]


def test_words_of_images(spark, stand_ins):
    images = adapters.pdf_images(pdf(spark, a=[{"w": 900, "h": 500}], b=[{"w": 100, "h": 100}]), 72)
    got = {(r.page.doc_id, r.ord): (r.text, r.left) for r in adapters.ocr_words(images).collect()}
    assert got == {("a", 0): ("E-101", 900), ("a", 1): ("", 0), ("b", 0): ("E-101", 100), ("b", 1): ("", 0)}


def two_documents(spark):
    """The scene twice, under equal page numbers; the second without its last pipes and with another tag."""
    one = scene(spark)
    with_doc = lambda x, doc: x.withColumn("doc_id", F.lit(doc))
    a = [with_doc(x, "a") if x is not None and not isinstance(x, bool) else x for x in one]
    other = one._replace(drawings=one.drawings.where("draw_id = 0"), reads=one.reads.withColumn("raw_text", F.replace("raw_text", F.lit("V-102"), F.lit("V-109"))))
    b = [with_doc(x, "b") if x is not None and not isinstance(x, bool) else x for x in other]
    return P.Primitives(*[x.unionByName(y) if hasattr(x, "unionByName") else x for x, y in zip(a, b)])


def test_two_documents_with_equal_page_numbers(spark):
    p = two_documents(spark)
    nodes, edges = P.whole_graph(p)
    labels = {d: {r.label for r in nodes.where(F.col("doc_id") == d).collect()} for d in "ab"}
    assert labels["a"] == {"FT-101", "UNLABELED-P0-UNLABELED-5", "V-101", "V-102", "P-101", "T-101"}
    assert labels["b"] == (labels["a"] - {"V-102"}) | {"V-109"}
    assert sorted(tuple(r) for r in edges.select("doc_id", "a", "b").collect()) == [("a", "FT-101", "V-101"), ("a", "P-101", "T-101"), ("a", "P-101", "V-101"), ("b", "P-101", "T-101")]
    one = P.one_page(p, 0, "b")
    assert {r.label for r in one[0].collect()} >= {"V-109"} and one[1].count() == 1
    with pytest.raises(ValueError):
        P.one_page(p, 0, "c")


def test_a_data_set_as_files(spark, tmp_path):
    for n in ("x", "y", "z"):
        (tmp_path / f"{n}.png").write_bytes(n.encode())
    images = spark.createDataFrame([(n, f"{tmp_path}/{n}.png") for n in "xyz"], "stem string, path string")
    files = spark.createDataFrame([("x", "1 0.5 0.5 0.1 0.1\n\n0 0.1 0.1 0.2 0.2"), ("y", "7 0 0 1 1")], "stem string, text string")
    classes = spark.createDataFrame([(0, 2), (1, 0)], "class_id int, new_class int")
    merged, stats = datasets.build([datasets.Part("p", {"train": (images, files)}, classes), datasets.Part("q", {"val": (images.where("stem = 'x'"), files)}, classes)])
    assert sorted(map(tuple, stats.collect())) == [("p", "train", 1, 2), ("q", "val", 1, 2)]
    for _ in range(2):
        sinks.write_dataset(merged, f"{tmp_path}/out")
    assert sorted(str(f.relative_to(tmp_path / "out")) for f in (tmp_path / "out").rglob("*") if f.is_file()) == ["data.yaml", "images/train/p_x.png", "images/val/q_x.png", "labels/train/p_x.txt", "labels/val/q_x.txt"]
    assert (tmp_path / "out/labels/train/p_x.txt").read_text() == "0 0.5 0.5 0.1 0.1\n2 0.1 0.1 0.2 0.2\n"
    assert (tmp_path / "out/images/val/q_x.png").read_bytes() == b"x"
    assert (tmp_path / "out/data.yaml").read_text() == f"path: {tmp_path}/out\ntrain: images/train\nval: images/val\nnc: 3\nnames: [valve, instrument, equipment]\n"


def test_a_score_as_one_document(spark, tmp_path):
    truth = spark.createDataFrame([("valve", "V-1"), ("valve", "V-2"), ("equipment", None)], "category string, tag string")
    nodes = spark.createDataFrame([("v-1", "valve"), ("P-9", "pump")], "tag string, component_type string")
    sinks.write_score(scoring.score(truth, nodes), str(tmp_path / "score"))
    (text,) = [r.value for r in spark.read.text(str(tmp_path / "score")).collect()]
    got = json.loads(text)
    assert got["tags"] == {"tp": 1, "fp": 1, "fn": 1, "precision": 0.5, "recall": 0.5, "f1": 0.5} and got["missed"] == ["V-2"]
    assert [(c["category"], c["ground_truth_count"], c["detected_count"], c["coverage_pct"]) for c in got["coverage"]] == [("equipment", 1, 1, 100.0), ("valve", 2, 1, 50.0)]


def test_the_command_line(spark, tmp_path, monkeypatch, capsys):
    from tagweave import __main__ as cli

    docx_file(tmp_path / "a.docx", "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in PROCEDURE.split("\n")))
    (tmp_path / "d.pdf").write_bytes(b"x")
    monkeypatch.setattr(cli, "primitives", lambda files, model: (scene(spark), files))
    monkeypatch.setattr(raster, "headers", lambda images: spark.createDataFrame([(("d", 0), "T-101 DESIGN: 200 PSIG @ 10F")], "page struct<doc_id: string, page: int>, text string"))
    cli.main(["--pid", f"{tmp_path}/d.pdf", "--sop", f"{tmp_path}/a.docx", "--out", f"{tmp_path}/out"])
    said = capsys.readouterr().out.splitlines()
    assert said == ["Diagram: 6 components, 3 connections", "Procedures: 5 tags referenced, 0 tags in tables of limits", "Title blocks: limits of 0 of 0 tags", "Findings: 2 error(s), 2 warning(s), 1 info"]
    assert (tmp_path / "out/report_log").exists() and (tmp_path / "out/graphml").exists()
