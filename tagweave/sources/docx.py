"""Procedures in .docx files, a row each: doc_id (its path), full_text, paragraphs, tables.

A .docx file is a zip of XML, which the standard library reads. ``procedures`` reads any file system that Spark does;
the data source ``spark.read.format("procedure_docx").load(path)`` reads paths that every machine has.
"""

from __future__ import annotations

import glob
import io
import os
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import SOP_DOCS

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def parse_docx(path: str | BinaryIO) -> tuple[str, list[str], list[list[list[str]]]]:
    """(full text, paragraphs, tables): stripped, without blank paragraphs; a merged cell fills all its columns."""
    if isinstance(path, str) and not os.path.exists(path):
        raise FileNotFoundError(f"no procedure at {path}")
    with zipfile.ZipFile(path) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    paragraphs = [t for p in body.findall(f"{_W}p") if (t := _text(p).strip())]
    tables = []
    for table in body.findall(f"{_W}tbl"):
        rows = []
        for row in table.findall(f"{_W}tr"):
            cells = []
            for cell in row.findall(f"{_W}tc"):
                span = cell.find(f"{_W}tcPr/{_W}gridSpan")
                times = int(span.get(f"{_W}val", "1")) if span is not None else 1
                cells += ["\n".join(_text(p) for p in cell.findall(f"{_W}p")).strip()] * times
            rows.append(cells)
        tables.append(rows)
    return "\n".join(paragraphs), paragraphs, tables


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        files = sorted(glob.glob(os.path.join(self.path, "*.docx"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path)) or [self.path]
        for f in files:
            if not os.path.exists(f):
                raise FileNotFoundError(f"no procedure at {f}")
        return [_File(f) for f in files]

    def read(self, partition: _File) -> Iterator[tuple]:
        yield (partition.path, *parse_docx(partition.path))


class ProcedureDocx(DataSource):
    @classmethod
    def name(cls) -> str:
        return "procedure_docx"

    def schema(self) -> str:
        return SOP_DOCS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProcedureDocx)


def procedures(spark: SparkSession, path: str) -> DataFrame:
    """SOP_DOCS of the .docx files at ``path``, on any file system that Spark reads; ValueError if there are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    if files.select("path").isEmpty():
        raise ValueError(f"no procedure at {path}")

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(name, *parse_docx(io.BytesIO(content))) for name, content in zip(f["path"], f["content"])], columns=["doc_id", "full_text", "paragraphs", "tables"])

    return files.mapInPandas(step, SOP_DOCS)
