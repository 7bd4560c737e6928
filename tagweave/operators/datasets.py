"""Relabelling and merging detection data sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.vocabulary import CLASS_NUMBERS, TYPE_CLASSES, lookup


def class_map(names: DataFrame) -> DataFrame:
    """(class_id, new_class) of names(class_id, name) that stand for a coarse class."""
    return names.select("class_id", lookup(S.type_of_class(F.col("name")), TYPE_CLASSES).alias("new_class")).where("new_class is not null")


def fixed_map(spark, numbers: dict[int, int] = CLASS_NUMBERS) -> DataFrame:
    return spark.createDataFrame(sorted(numbers.items()), "class_id int, new_class int")


def box_lines(files: DataFrame) -> DataFrame:
    """(stem, line_no, class_id, rest) of label files(stem, text): a class and four numbers a line; blank lines don't count."""
    lines = files.select("stem", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"))
    parts = F.split(S.stripped(F.col("line")), r"(?U)\s+")
    lines = lines.where(S.stripped(F.col("line")) != "").select("stem", "line_no", parts.alias("parts"))
    return lines.select("stem", "line_no", F.get("parts", F.lit(0)).cast("int").alias("class_id"), F.array_join(F.slice("parts", 2, 1 << 30), " ").alias("rest"))


def relabel(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """Lines of known classes under their new number: stem, line_no, label."""
    on = lines.join(classes, "class_id")
    return on.select("stem", "line_no", F.concat_ws(" ", F.col("new_class").cast("string"), F.nullif(F.col("rest"), F.lit(""))).alias("label"))


def merged_split(images: DataFrame, lines: DataFrame, classes: DataFrame, prefix: str, split: str) -> DataFrame:
    """(source, split, name, path, boxes, labels) of images(stem, path) with a label file of at least one known box."""
    per = relabel(lines, classes).groupBy("stem").agg(F.count("*").alias("boxes"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "label"))), lambda x: x["label"]), "\n").alias("labels"))
    on = images.join(per, "stem")
    return on.select(F.lit(prefix).alias("source"), F.lit(split).alias("split"), F.concat(F.lit(f"{prefix}_"), F.col("stem")).alias("name"), "path", "boxes", "labels")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_stats(merged: DataFrame) -> DataFrame:
    """(source, split, images, boxes)."""
    return merged.groupBy("source", "split").agg(F.count_distinct("name").alias("images"), F.sum("boxes").alias("boxes"))


class Part(NamedTuple):
    """A source of a data set: its images(stem, path) and label files(stem, text) by split, and its classes(class_id, new_class)."""

    prefix: str
    splits: Mapping[str, tuple[DataFrame, DataFrame]]
    classes: DataFrame


def build(parts: Sequence[Part]) -> tuple[DataFrame, DataFrame]:
    """(merged, stats by source and split) of all parts' splits; ``sinks.write_dataset`` writes the first."""
    merged = union_all([merged_split(images, box_lines(files), part.classes, part.prefix, split) for part in parts for split, (images, files) in part.splits.items()])
    return merged, split_stats(merged)
