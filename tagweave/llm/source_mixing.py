"""Mixing sources to target weights.

The tokens of each source are packed, document after document, into blocks of fixed length. Each output shard
draws how many of its slots come from each source (one multinomial draw, seeded by the shard). A source's slots
are numbered through all shards; slot j takes block P(j mod n) of that source, P being a pseudorandom
permutation of its n blocks (a Feistel network with cycle walking), another one for each pass over them.
Slots and blocks meet in one join by (source, block).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, batch_of, cut, mix64, pick, ranges

BLOCK_TOKENS = 1024
SHARD_SLOTS = 256
TEMPERATURE = 0.7
SEED = 20240229
DOCS_PER_BUCKET = 20_000
SHARDS_PER_SPAN = 4096
MAX_SOURCES = 1_000_000


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """P_key(i) for a pseudorandom permutation P_key of 0..n-1, elementwise."""
    i, n, key = (np.array(np.broadcast_to(x, np.shape(i))).astype(np.uint64) for x in (i, n, key))
    bits = np.array([max(2, int(x - 1).bit_length()) for x in np.unique(n)])
    bits = bits[np.searchsorted(np.unique(n), n)]
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(i))
    x = i.copy()
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            f = mix64(right + mix64(key[todo] + np.uint64(r * 0x9E3779B9 + 1))) & mask[todo]
            left, right = right, left ^ f
        x[todo] = left << half[todo] | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def source_key(source: Column) -> Column:
    return F.xxhash64(source.isNull(), source)


_VISIBLE = np.ones(256, dtype=bool)
_VISIBLE[list(SPACE.encode())] = False


def count_tokens(text: pa.StringScalar) -> int:
    """Runs of visible characters; a null has none."""
    raw = text.as_buffer()
    if raw is None or not raw.size:
        return 0
    seen = _VISIBLE[np.frombuffer(raw, dtype=np.uint8)]
    return int(seen[0]) + int(np.count_nonzero(seen[1:] > seen[:-1]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, hash, text) -> (doc_id, key, hash, n)."""
    for b in batches:
        n = pa.array([count_tokens(t) for t in b.column(3)], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], n], names=["doc_id", "key", "hash", "n"])


_pieces: dict[int, re.Pattern] = {}


def _cut(block_tokens: int):
    """(doc_id, source, lang, key, n, copies, start, text) -> pieces of the blocks that the copies of the document lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(r"\S++\s*+", re.ASCII)  # as Java counts
        full = _pieces.setdefault(block_tokens, re.compile(rf"(?:\S++\s*+){{{block_tokens}}}", re.ASCII))
        for b in batches:
            rows = b.to_pydict()
            doc, text, source, lang, key, block, at, count = [], [], [], [], [], [], [], []
            for d, s, g, k, n, copies, first, t in zip(*rows.values()):
                t = t.strip(SPACE) + "\n"
                for start in range(first, first + copies * n, n):
                    pos, done = 0, 0
                    while done < n:
                        into = (start + done) % block_tokens
                        take = min(block_tokens - into, n - done)
                        if take == n - done:
                            end = len(t)
                        elif take == block_tokens:
                            end = full.match(t, pos).end()
                        else:
                            end = pos
                            for _ in range(take):
                                end = token.match(t, end).end()
                        doc.append(d)
                        text.append(t[pos:end])
                        source.append(s)
                        lang.append(g)
                        key.append(k)
                        block.append((start + done) // block_tokens)
                        at.append(into)
                        count.append(take)
                        pos, done = end, done + take
            yield batch_of({"key": (key, pa.int64()), "block": (block, pa.int64()), "at": (at, pa.int32()), "n": (count, pa.int32()), "doc_id": (doc, pa.int64()), "source": (source, pa.string()), "lang": (lang, pa.string()), "piece": (text, pa.string())})

    return run


def _draw(keys: list[int], weights: np.ndarray, slots: int, shard_slots: int, seed: int):
    """Shard numbers -> (shard, key, at, n): n slots from ``at`` on are of source ``key``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for shard in f["id"]:
                size = min(shard_slots, slots - shard * shard_slots)
                n = np.random.Generator(np.random.PCG64([seed, shard])).multinomial(size, weights)
                took = np.flatnonzero(n)
                out.append(pd.DataFrame({"shard": shard, "key": np.array(keys, dtype=np.int64)[took], "at": (np.cumsum(n) - n)[took], "n": n[took]}))
            yield pd.concat(out) if out else pd.DataFrame({"shard": [], "key": [], "at": [], "n": []}, dtype="int64")

    return run


def _assign(blocks: dict[int, int], slots: int, shard_slots: int, seed: int):
    """(shard, key, at, n, first) -> (shard, slot, key, epoch, block) for each of the n slots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["n"].to_numpy()
            rep = lambda c: np.repeat(f[c].to_numpy(), n)
            i = ranges(n)
            shard, key = rep("shard"), rep("key")
            of = np.repeat(np.array([blocks[k] for k in f["key"]], dtype=np.int64), n)
            j = rep("first") + i
            size = np.minimum(shard_slots, slots - shard * shard_slots)
            slot = permuted(rep("at") + i, size, mix64(shard.astype(np.uint64) + np.uint64(seed)))
            epoch = j // of if len(j) else j
            block = permuted(j % of if len(j) else j, of, mix64(key.astype(np.uint64) ^ mix64(epoch.astype(np.uint64) + np.uint64(seed))))
            yield pd.DataFrame({"shard": shard, "slot": slot, "key": key, "epoch": epoch, "block": block})

    return run


def _before(df: DataFrame, amount: str, key: str, part: str, order: list[str], to: str) -> DataFrame:
    """``df`` with the sum of ``amount`` of the rows of its key before it, in the order of (part, order).

    Sums within parts, and of the parts before: no task sees more than a part, or the sums of a key's parts.
    """
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.groupBy(key, part).agg(F.sum(amount).alias("_sum"))
    sums = sums.select(key, part, (F.sum("_sum").over(so_far(Window.partitionBy(key).orderBy(part))) - F.col("_sum")).alias("_base"))
    inner = F.sum(amount).over(so_far(Window.partitionBy(key, part).orderBy(*order))) - F.col(amount)
    return df.withColumn("_inner", inner).join(sums, [key, part]).withColumn(to, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, temperature: float = TEMPERATURE, slots: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Blocks in their slots: shard, slot, source, epoch, block, n_tokens, doc_ids, lang, text.

    ``weights`` are relative target weights by source; sources that it doesn't name get 0. None: the number of
    tokens of the source to the power ``temperature``. ``slots`` None: as many as there are blocks in all, so the
    output is as large as the input; light sources then come more than once, heavy ones in part.

    Tokens are runs of visible characters with the white space after them. Every token is in exactly one block;
    only the last block of a source may be shorter. Documents follow each other in an order that hashes of their
    ids fix, with a line break after each. doc_ids and lang (of the first piece) say what a block is made of.
    Documents whose text is null, empty or blank have no token and are in no block; null is a source like any
    other, and so is a null doc_id an id; rows that are wholly alike come one after another, as often as the table has
    them, so there are no ties. Long texts go on through as many blocks as they take. Other columns are ignored,
    whatever their names. An empty table, or weights that name no source of it, give an empty one. The table of
    sources (not of documents) is brought to the driver; beyond ``MAX_SOURCES`` of them ValueError is raised.
    """
    spark = docs.sparkSession
    own = pick(docs, doc_id=id_col, source=source_col, lang=lang_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    own = own.withColumns({"key": source_key(F.col("source")), "hash": F.xxhash64("text", F.lit(1), "lang")})
    counted = own.select("doc_id", "key", "hash", "text").mapInArrow(_counted, "doc_id bigint, key bigint, hash bigint, n bigint").where("n > 0")
    counted = cut(counted.groupBy("doc_id", "key", "hash", "n").agg(F.count("*").alias("copies")))
    mass = (F.col("n") * F.col("copies")).alias("mass")
    totals = counted.groupBy("key").agg(F.sum(mass).alias("tokens")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted((r["key"], r["tokens"]) for r in totals)
    blocks = {k: -(-t // block_tokens) for k, t in totals}
    if weights is None:
        w = np.array([t**temperature for _, t in totals], dtype=float)
    else:
        named = spark.createDataFrame([(s, float(x)) for s, x in weights.items()], "source string, w double").select(source_key(F.col("source")).alias("key"), "w").collect()
        by = {r["key"]: r["w"] for r in named}
        w = np.array([by.get(k, 0.0) for k, _ in totals], dtype=float)
    slots = sum(blocks.values()) if slots is None else slots
    if not totals or w.sum() <= 0:
        slots, w = 0, np.ones(max(1, len(totals)))

    # where each document starts in its source: sums within buckets, and of the buckets before
    buckets = max(1, math.ceil(counted.count() / DOCS_PER_BUCKET))
    placed = counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    starts = _before(placed.select("*", mass), "mass", "key", "bucket", ["doc_id", "hash"], "start")
    starts = starts.select(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key"), F.col("hash").alias("s_hash"), "n", "copies", "start")

    at = own.join(starts.hint("shuffle_hash"), own["doc_id"].eqNullSafe(starts["s_id"]) & (own["hash"] == starts["s_hash"]) & (own["key"] == starts["s_key"]))
    at = at.select("doc_id", "source", "lang", "key", "n", "copies", "start", "text")
    if not counted.where("copies > 1").isEmpty():  # one row stands for all that are alike
        repeated = at.where("copies > 1").groupBy("key", "start").agg(F.first(F.struct(*at.columns)).alias("r")).select("r.*")
        at = at.where("copies = 1").unionByName(repeated)
    pieces = at.mapInArrow(_cut(block_tokens), "key bigint, block bigint, at int, n int, doc_id bigint, source string, lang string, piece string")
    packed = pieces.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("at", "n", "doc_id", "source", "lang", "piece"))).alias("p"))
    packed = packed.select("key", "block", F.col("p.source")[0].alias("source"), F.aggregate("p.n", F.lit(0), lambda a, x: a + x).alias("n_tokens"), F.array_distinct("p.doc_id").alias("doc_ids"), F.col("p.lang")[0].alias("lang"), F.array_join("p.piece", "").alias("text"))

    shards = spark.range(-(-slots // shard_slots))
    drawn = shards.mapInPandas(_draw([k for k, _ in totals], w / w.sum(), slots, shard_slots, seed), "shard bigint, key bigint, at bigint, n bigint")
    drawn = _before(drawn.withColumn("span", F.expr(f"shard div {SHARDS_PER_SPAN}")), "n", "key", "span", ["shard"], "first")
    wanted = drawn.select("shard", "key", "at", "n", "first").mapInPandas(_assign(blocks, slots, shard_slots, seed), "shard bigint, slot bigint, key bigint, epoch bigint, block bigint")
    return wanted.join(packed.hint("shuffle_hash"), ["key", "block"]).select("shard", "slot", "source", "epoch", "block", "n_tokens", "doc_ids", "lang", "text")


def op10(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed: shard, slot, source, epoch, block, n_tokens, doc_ids, text."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lang")
