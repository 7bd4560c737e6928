"""Row numbers without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE = 2048


def number_rows(df: DataFrame, by: list[str], order: list[str], name: str, lead: tuple[str, ...] = (), width: int = SLICE) -> DataFrame:
    """``df`` with ``name``: row_number() over (partition by ``by`` order by ``lead``, ``order``), from 1.

    ``order`` starts with a column of whole numbers. Rows are sorted within slices of ``width`` of these numbers, and
    start at the count of the rows of all slices before, so that a task holds some slices instead of a group.
    """
    at = F.struct(*by, *lead, F.floor(F.col(order[0]) / width).alias("_slice"))
    placed = df.withColumn("_at", at)
    before = Window.partitionBy(*[F.col("_at")[c] for c in by]).orderBy(*[F.col("_at")[c] for c in (*lead, "_slice")]).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_at").agg(F.count("*").alias("_n")).select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_at").orderBy(*order))
    return placed.join(starts, "_at").withColumn(name, nth + F.col("_before")).drop("_at", "_before")
