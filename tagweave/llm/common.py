"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: What Java's \s means, and Python's under re.ASCII.
SPACE = " \t\n\r\f\v"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a session that runs on one machine and names no such folder (a test) gets a temporary one; on a cluster
    RuntimeError is raised.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return named or sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, of which several results can be read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that don't clash with those of ``df`` (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def pick(df: DataFrame, **renamed: str) -> DataFrame:
    """Only the named columns, under the operator's own names; extra columns can't clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in renamed.items()])


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: list[str | None], chars: int = 3_000_000) -> Iterator[slice]:
    """Slices of a batch of about so many characters, so that what a worker holds doesn't follow the length of its texts."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size > chars:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def batch_of(columns: dict[str, tuple]) -> pa.RecordBatch:
    """columns: name -> (values, arrow type)."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node, root = least node.

    Alternates large-star and small-star steps, which keep the components and end, after about
    log(n) rounds, with each node joined straight to its least member. Each round is cut with a checkpoint.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        step = cut(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        # done when every node has one edge and no root has an edge upwards
        open_ = step.groupBy("a").count().where("count > 1").select("a").unionByName(step.join(step.select(F.col("a").alias("b")), "b", "left_semi").select("a"))
        e = step
        if open_.isEmpty():
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
