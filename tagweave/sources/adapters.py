"""Adapters that bring primitives: optional, each behind an import or a service that may be missing.

An adapter maps one table to another in Arrow batches on the workers. Everything behind it is relational, so a table
read from files serves as well as any adapter.
"""

from __future__ import annotations

import base64
import json
import os
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import label_crop
from ..functions.vocabulary import COARSE3
from ..operators.spatial import TILE, tile_offsets
from ..schemas import DETECTIONS, DRAWINGS, OCR_WORDS, PAGES

Batches = Iterator[pd.DataFrame]


DOCUMENT_PAGE = "page struct<doc_id: string, page: int>"


def adapt(df: DataFrame, step: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``step`` over the batches of ``df``; page is of the type that it has in ``df``."""
    if "page" in df.columns:
        schema = schema.replace("page int", f"page {df.schema['page'].dataType.simpleString()}")
    return df.mapInPandas(step, schema)


def pdf_pages(files: DataFrame, dpi: int = 200) -> DataFrame:
    """PAGES of PDF files(path, content), as read with ``binaryFile``; page is (doc_id: the path, page).

    Needs PyMuPDF on the workers.
    """

    def step(frames: Batches) -> Batches:
        import fitz

        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    if not len(doc):
                        raise ValueError("no pages: " + path)
                    for k, page in enumerate(doc):
                        m = page.rotation_matrix
                        rows.append({"page": {"doc_id": path, "page": k}, "width": page.rect.width, "height": page.rect.height, "dpi": dpi, "matrix": {"a": m.a, "b": m.b, "c": m.c, "d": m.d, "e": m.e, "f": m.f}})
            yield pd.DataFrame(rows, columns=["page", "width", "height", "dpi", "matrix"])

    return adapt(files.select("path", "content"), step, PAGES.replace("page int", DOCUMENT_PAGE))


def pdf_drawings(files: DataFrame) -> DataFrame:
    """DRAWINGS of PDF files(path, content); none for scans. Needs PyMuPDF on the workers."""

    def step(frames: Batches) -> Batches:
        import fitz

        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    for k, page in enumerate(doc):
                        for n, d in enumerate(page.get_drawings()):
                            items = [{"op": i[0], "pts": [{"x": p.x, "y": p.y} for p in i[1:] if hasattr(p, "x") and not hasattr(p, "x0")]} for i in d["items"]]
                            r = d["rect"]
                            rows.append({"page": {"doc_id": path, "page": k}, "draw_id": n, "type": d["type"], "items": items, "rect": {"x0": r.x0, "y0": r.y0, "x1": r.x1, "y1": r.y1}})
            yield pd.DataFrame(rows, columns=["page", "draw_id", "type", "items", "rect"])

    return adapt(files.select("path", "content"), step, DRAWINGS.replace("page int", DOCUMENT_PAGE))


IMAGES = "page int, png binary, width int, height int"


def pdf_images(files: DataFrame, dpi: int = 200) -> DataFrame:
    """IMAGES of the pages of PDF files(path, content), rendered at ``dpi``. Needs PyMuPDF on the workers."""

    def step(frames: Batches) -> Batches:
        import fitz

        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    if not len(doc):
                        raise ValueError("no pages: " + path)
                    for k, page in enumerate(doc):  # a page at a time: pixels are large
                        picture = page.get_pixmap(dpi=dpi)
                        yield pd.DataFrame({"page": [{"doc_id": path, "page": k}], "png": [picture.tobytes("png")], "width": [picture.width], "height": [picture.height]})

    return adapt(files.select("path", "content"), step, IMAGES.replace("page int", DOCUMENT_PAGE))


def cut_out(images: DataFrame, boxes: DataFrame, columns: list[str], times: int = 1) -> DataFrame:
    """boxes(page, .., x0, y0, x1, y1) -> page, ``columns``, and the png of that part of the page, enlarged ``times``.

    Boxes of no area are left out. Needs Pillow on the workers. The pictures of a page meet its boxes in one join.
    """
    on = boxes.where("x1 > x0 and y1 > y0").select("page", *columns, "x0", "y0", "x1", "y1").join(images.select("page", "png"), "page")
    kinds = ", ".join(f"{c} {on.schema[c].dataType.simpleString()}" for c in columns)

    def step(frames: Batches) -> Batches:
        import io

        from PIL import Image

        for f in frames:
            out = []
            for png, *box in zip(f["png"], f["x0"], f["y0"], f["x1"], f["y1"]):
                part = Image.open(io.BytesIO(bytes(png))).crop(tuple(int(v) for v in box))
                if times > 1:
                    part = part.resize((part.width * times, part.height * times))
                into = io.BytesIO()
                part.save(into, "PNG")
                out.append(into.getvalue())
            yield f[["page", *columns]].assign(png=out)

    return adapt(on, step, f"page int, {kinds}, png binary")


CROP_MARGIN, CROP_TIMES = 40, 4


def label_crops(images: DataFrame, shapes: DataFrame, margin: int = CROP_MARGIN, times: int = CROP_TIMES) -> DataFrame:
    """(page, ord, png) round the labels of shapes(page, shape_id, bbox), for a model to read: what ``model_replies`` takes."""
    sized = shapes.select("page", F.col("shape_id").alias("ord"), "bbox").join(images.select("page", F.col("width").alias("pw"), F.col("height").alias("ph")), "page")
    return cut_out(images, sized.select("page", "ord", label_crop(F.col("bbox"), F.col("pw"), F.col("ph"), margin).alias("c")).select("page", "ord", "c.*"), ["ord"], times)


def page_tiles(images: DataFrame) -> DataFrame:
    """(page, tile_x, tile_y, png) of each page's overlapping tiles: what ``detections`` takes."""
    at = tile_offsets(images.select("page", "width", "height"))
    end = lambda c, size: F.least(F.col(c) + TILE, F.col(size)).cast("int")
    boxes = at.select("page", "tile_x", "tile_y", F.col("tile_x").alias("x0"), F.col("tile_y").alias("y0"), end("tile_x", "width").alias("x1"), end("tile_y", "height").alias("y1"))
    return cut_out(images, boxes, ["tile_x", "tile_y"])


READ_PROMPT = "The picture shows one symbol of a piping diagram. Reply with the tag that labels it, such as FT-101, and nothing else; reply UNKNOWN if there is none."
_KINDS = ", ".join(COARSE3)
TYPE_PROMPT = f"The picture shows one symbol of a piping diagram. Reply with its class, one of {_KINDS}, then a comma and its type, such as gate valve; reply unknown if you can't tell."


def ocr_words(images: DataFrame) -> DataFrame:
    """OCR_WORDS of images(page, png). Needs Tesseract and its Python wrapper on the workers."""

    def step(frames: Batches) -> Batches:
        import io

        import pytesseract
        from PIL import Image

        for f in frames:
            out = []
            for page, png in zip(f["page"], f["png"]):
                d = pytesseract.image_to_data(Image.open(io.BytesIO(png)), output_type=pytesseract.Output.DICT)
                out += [{"page": page, "ord": k, **{c: d[c][k] for c in ("text", "left", "top", "width", "height")}} for k in range(len(d["text"]))]
            yield pd.DataFrame(out, columns=["page", "ord", "text", "left", "top", "width", "height"])

    return adapt(images.select("page", "png"), step, OCR_WORDS)


def detections(tiles: DataFrame, weights: str, confidence: float = 0.25) -> DataFrame:
    """DETECTIONS and tile offsets of tiles(page, tile_x, tile_y, png). Needs a detector's library on the workers.

    FileNotFoundError if there are no weights at that path, before anything is planned.
    """
    if not os.path.exists(weights):
        raise FileNotFoundError(f"no weights at {weights}")

    def step(frames: Batches) -> Batches:
        import io

        from PIL import Image
        from ultralytics import YOLO

        model = YOLO(weights)
        for f in frames:
            out = []
            for page, x, y, png in zip(f["page"], f["tile_x"], f["tile_y"], f["png"]):
                for result in model.predict(Image.open(io.BytesIO(png)), conf=confidence, verbose=False):
                    for n, b in enumerate(result.boxes):
                        c = [int(v) for v in b.xyxy[0].tolist()]
                        out.append({"page": page, "ord": 1_000_000 * y + 1_000 * x + n, "xyxy": dict(zip(("x0", "y0", "x1", "y1"), c)), "class_name": result.names[int(b.cls[0])], "confidence": float(b.conf[0]), "tile_x": x, "tile_y": y})
            yield pd.DataFrame(out, columns=["page", "ord", "xyxy", "class_name", "confidence", "tile_x", "tile_y"])

    return adapt(tiles.select("page", "tile_x", "tile_y", "png"), step, f"{DETECTIONS}, tile_x int, tile_y int")


def ask(url: str, model: str, prompt: str, png: bytes, timeout: float = 180.0) -> str:
    """A vision model's reply; empty on any failure of network or format."""
    body = {"options": {"temperature": 0}, "model": model, "stream": False, "images": [base64.b64encode(png).decode()], "prompt": prompt}
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return str(json.loads(r.read()).get("response", "")).strip()
    except (OSError, ValueError, AttributeError):
        return ""


def available(url: str, timeout: float = 2.0) -> bool:
    """Whether a service answers; asked on the driver before a plan uses it."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status == 200
    except (OSError, ValueError):
        return False


def model_replies(crops: DataFrame, url: str, model: str, prompt: str, timeout: float = 180.0) -> DataFrame:
    """(page, ord, reply) of crops(page, ord, png); replies are parsed by ``scalars.loose_tag`` or ``classification``."""

    def step(frames: Batches) -> Batches:
        for f in frames:
            yield pd.DataFrame({"page": f["page"], "ord": f["ord"], "reply": [ask(url, model, prompt, bytes(p), timeout) for p in f["png"]]})

    return adapt(crops.select("page", "ord", "png"), step, "page int, ord bigint, reply string")
