"""Schemas of the engine's tables.

Adapters bring primitives (drawings, words, detections, header texts, paragraphs, table cells) in these tables; every
table has an ``ord`` column where order matters, as rows have none.
"""

DRAWINGS = "page int, draw_id bigint, type string, items array<struct<op string, pts array<struct<x double, y double>>>>, rect struct<x0 double, y0 double, x1 double, y1 double>"
PAGES = "page int, width double, height double, dpi int, matrix struct<a double, b double, c double, d double, e double, f double>"
SHAPES = "page int, ord bigint, kind string, bbox struct<x int, y int, w int, h int>, center struct<x int, y int>"
SYMBOLS = "page int, ord bigint, shape_id bigint, kind string, bbox struct<x int, y int, w int, h int>, tag string, raw_text string, source string, override string"
SEGMENTS = "page int, seg_id bigint, x1 double, y1 double, x2 double, y2 double"
CONTOURS = "page int, idx int, parent int, area double, perimeter double, vertices int, hull_area double, x int, y int, w int, h int"
DETECTIONS = "page int, ord bigint, xyxy struct<x0 int, y0 int, x1 int, y1 int>, class_name string, confidence double"
OCR_WORDS = "page int, ord bigint, text string, left int, top int, width int, height int"
OCR_READS = "page int, ord bigint, attempt int, raw_text string"
HEADERS = "page int, text string"
SOP_DOCS = "doc_id string, full_text string, paragraphs array<string>, tables array<array<array<string>>>"
NODES = "label string, page int, ord bigint, shape_id bigint, tag string, ocr_raw_text string, symbol_kind string, component_type string, bbox struct<x int, y int, w int, h int>, tag_confidence string"
EDGES = "a string, b string"
LIMITS = "tag string, raw_label string, pressure_psig double, temperature_f string"
TRUTH = "page int, category string, tag string, bbox array<double>"
FINDINGS = "severity string, category string, message string"
