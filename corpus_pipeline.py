"""From raw documents to token ids: quality rules, line dedup, near-dedup, source mixing, SentencePiece.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to
the shared folder and reads again, so that a lost executor never costs more than the current stage. A stage's table
is deleted when that of the next is written; the last stays, as the result reads it.

All stages take any table with the columns of documents, in which any value may be null; further columns, whatever
their names, are dropped by the first. All take whole texts, however long, and give an empty table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import delete, shared_dir
from tagweave.llm.line_dedup import dedup_lines
from tagweave.llm.quality_rules import clean_lines
from tagweave.llm.sentencepiece_codec import encode
from tagweave.llm.simhash_dedup import simhash_survivors
from tagweave.llm.source_mixing import SHARD_SLOTS, mix_sources

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted again."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; documents that lose more than half of their text go.

    Documents whose text is null, empty or blank go. A null doc_id, source or lang doesn't matter; repeated rows are
    judged alike and stay or go together; there are no ties, as each row is judged by itself.
    """
    return _documents(clean_lines(docs.select(*COLUMNS)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before go; documents of which nothing is left go.

    The earliest line by (doc_id, line number) stays, documents without id last. Rows of one doc_id, null included,
    are versions of one document: lines that they share at the same number stay or go together, so repeated rows do.
    A null, empty or blank text stays as it is. Near copies lose what they share with earlier ones here: what is
    left of them is text that no earlier document has.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    return _documents(out.where("text is null or n_dropped = 0 or n_lines > n_dropped"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id.

    Documents whose doc_id is null, or whose text is null, empty or without a word, stay. Rows of one doc_id are one
    document and stay or go together, so there are no ties.
    """
    return simhash_survivors(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the sources, in the shares of the target weights; doc_id is the slot's number in the mixture.

    Null is a source like any other; documents without a token (null, empty, blank) are in no block; repeated rows
    are in it as often as they come; a long text goes on through several blocks. lang is that of a block's first piece.
    """
    out = mix_sources(docs.select(*COLUMNS))
    return _documents(out.withColumn("doc_id", F.col("shard") * SHARD_SLOTS + F.col("slot")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and ids, n_tokens, decoded.

    A null text has null ids, n_tokens and decoded; an empty one no ids, 0 and an empty text. Other nulls don't
    matter; repeated rows are encoded alike; there are no ties.
    """
    return encode(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("SentencePiece", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
