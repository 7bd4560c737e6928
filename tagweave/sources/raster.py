"""Adapters over page images: contours, raster pipe segments, readings of label crops, header texts.

They need OpenCV (and Tesseract for texts) on the workers, which is looked for only when a batch is processed. What
they emit are primitives; classification, admission and choice between readings are relational and live in operators.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import label_crop
from ..schemas import CONTOURS, HEADERS, OCR_READS, SEGMENTS
from .adapters import adapt

Batches = Iterator[pd.DataFrame]
LABEL_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-"
HEADER_SHARE, HEADER_MARGIN = 0.16, 0.04


def _gray(png: bytes):
    import cv2 as cv
    import numpy as np

    return cv.imdecode(np.frombuffer(png, np.uint8), cv.IMREAD_GRAYSCALE)


def _ink(gray):
    """White where there is ink."""
    import cv2 as cv

    return cv.threshold(src=gray, thresh=0, maxval=255, type=cv.THRESH_OTSU | cv.THRESH_BINARY_INV)[1]


def _paper(gray, times: int):
    """Black on white, enlarged."""
    import cv2 as cv

    large = cv.resize(gray, dsize=None, fx=times, fy=times, interpolation=cv.INTER_CUBIC)
    return cv.threshold(src=large, thresh=0, maxval=255, type=cv.THRESH_OTSU)[1]


def contours(images: DataFrame) -> DataFrame:
    """CONTOURS of images(page, png): the tree of outlines that an 11-pixel opening leaves, without pipes and letters."""

    def step(frames: Batches) -> Batches:
        import cv2 as cv

        brush = cv.getStructuringElement(shape=cv.MORPH_ELLIPSE, ksize=(11, 11))
        for f in frames:
            rows = []
            for page, png in zip(f["page"], f["png"]):
                found, tree = cv.findContours(cv.morphologyEx(_ink(_gray(png)), op=cv.MORPH_OPEN, kernel=brush), mode=cv.RETR_TREE, method=cv.CHAIN_APPROX_SIMPLE)
                for k, c in enumerate(found):
                    around = cv.arcLength(c, closed=True)
                    corners = cv.approxPolyDP(c, epsilon=0.02 * around, closed=True)
                    x, y, w, h = cv.boundingRect(c)
                    rows.append((page, k, int(tree[0][k][3]), cv.contourArea(c), around, len(corners), cv.contourArea(cv.convexHull(c)), x, y, w, h))
            yield pd.DataFrame(rows, columns=["page", "idx", "parent", "area", "perimeter", "vertices", "hull_area", "x", "y", "w", "h"])

    return adapt(images.select("page", "png"), step, CONTOURS)


def raster_segments(images: DataFrame, shapes: DataFrame, pad: int = 5) -> DataFrame:
    """SEGMENTS of images(page, png): straight lines outside of the page's shapes(page, bbox); none with fewer than two."""
    boxes = shapes.groupBy("page").agg(F.collect_list(F.array("bbox.x", "bbox.y", "bbox.w", "bbox.h")).alias("boxes")).where(F.size("boxes") >= 2)

    def step(frames: Batches) -> Batches:
        import cv2 as cv

        for f in frames:
            rows = []
            for page, png, inside in zip(f["page"], f["png"], f["boxes"]):
                ink = _ink(_gray(png))
                for x, y, w, h in inside:
                    ink[max(0, y - pad) : y + h + pad, max(0, x - pad) : x + w + pad] = 0
                lines = cv.HoughLinesP(ink, rho=1, theta=math.pi / 180, threshold=40, minLineLength=30, maxLineGap=10)
                rows += [(page, k, *map(float, line.ravel())) for k, line in enumerate(lines if lines is not None else [])]
            yield pd.DataFrame(rows, columns=["page", "seg_id", "x1", "y1", "x2", "y2"])

    return adapt(images.select("page", "png").join(boxes, "page"), step, SEGMENTS)


def label_reads(images: DataFrame, shapes: DataFrame, margin: int = 40) -> DataFrame:
    """OCR_READS of the label crops of shapes(page, shape_id, bbox): upright, then turned either way, each in two modes.

    ``operators.text.first_success`` takes the first with a tag.
    """
    wanted = shapes.select("page", "shape_id", "bbox").join(images.select("page", "png", "width", "height"), "page")
    wanted = wanted.select("page", "shape_id", "png", label_crop(F.col("bbox"), F.col("width").cast("int"), F.col("height").cast("int"), margin).alias("c")).select("page", "shape_id", "png", "c.*")

    def step(frames: Batches) -> Batches:
        import cv2 as cv
        import pytesseract

        for f in frames:
            rows = []
            for page, shape, png, x0, y0, x1, y1 in f.itertuples(index=False):
                crop = _gray(png)[y0:y1, x0:x1]
                if not crop.size:
                    continue
                upright = _paper(crop, 3)
                turned = [upright, cv.rotate(upright, cv.ROTATE_90_CLOCKWISE), cv.rotate(upright, cv.ROTATE_90_COUNTERCLOCKWISE)]
                for k, (picture, mode) in enumerate((p, m) for p in turned for m in (7, 11)):
                    rows.append((page, shape, k, pytesseract.image_to_string(picture, config=f"--psm {mode} -c tessedit_char_whitelist={LABEL_LETTERS}").strip()))
            yield pd.DataFrame(rows, columns=["page", "ord", "attempt", "raw_text"])

    return adapt(wanted, step, OCR_READS)


def headers(images: DataFrame) -> DataFrame:
    """HEADERS of images(page, png): the text of the top of each page, without the ladders at its sides."""

    def step(frames: Batches) -> Batches:
        import pytesseract

        for f in frames:
            rows = []
            for page, png in zip(f["page"], f["png"]):
                gray = _gray(png)
                h, w = gray.shape
                top = gray[: int(h * HEADER_SHARE), int(w * HEADER_MARGIN) : int(w * (1 - HEADER_MARGIN))]
                rows.append((page, pytesseract.image_to_string(_paper(top, 2), config="--psm 6")))
            yield pd.DataFrame(rows, columns=["page", "text"])

    return adapt(images.select("page", "png"), step, HEADERS)
