"""Streams of procedures: facts as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import BOUND_TAG


def tag_mentions(docs: DataFrame, text_col: str = "full_text") -> DataFrame:
    """(doc_id, tag, position) of each mention; works on batches and on streams alike."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.upper(F.col(text_col)), F.lit(BOUND_TAG), F.lit(1))).alias("position", "tag"))


def missing_as_they_come(docs: DataFrame, nodes: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Write to ``out`` (parquet) the mentions of tags that the graph lacks, batch by batch, each once."""
    gone = tag_mentions(docs).join(nodes.where("tag is not null").select("tag").distinct(), "tag", "left_anti")
    return gone.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
