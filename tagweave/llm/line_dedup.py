"""Line dedup by a deletion-neighbourhood join.

Lines are first made distinct (128-bit hashes, no text is shuffled). Of two distinct lines within k edits the longer
has one of k + 1 parts of the shorter unchanged, near its place; lines that share no such part with any other line
can have no partner and emit nothing. All others emit every deletion of up to k of their characters, and themselves,
as hashed keys; equal keys give candidate pairs, whose Levenshtein distance is then verified on the texts. The
earliest line stays.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import SPACE, batch_of, cut, fresh, mix64, pick

MIN_CHARS = 10
KEYS_PER_BUCKET = 2_000_000

BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def blank(line: Column) -> Column:
    return F.regexp_replace(line, r"\s+", "") == ""


def _parts(line: Column, n: Column, edits: int) -> Column:
    """Hashes of the parts that a line has in common with any line of ``edits`` edits at most (one of them at least).

    The shorter line, of M characters, is cut into edits + 1 parts. In the longer, of M + d, part i is moved by as many
    characters as edits before it (i at most) and after it (edits - i at most, but for the d) allow.
    """
    keys = []
    for d in range(edits + 1):
        m = n - F.lit(d)
        for i in range(edits + 1):
            begin, end = (F.floor(m * j / (edits + 1)).cast("int") for j in (i, i + 1))
            for shift in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1):
                keys.append(F.xxhash64(m, F.lit(i), F.substring(line, begin + shift + 1, end - begin)))
    return F.array(*keys)


def deletion_keys(line: str, edits: int = 1) -> np.ndarray:
    """Keys of the line and of the line without any of up to ``edits`` characters; each in constant time.

    The key of a string is the sum of mix(c_j) * BASE**j modulo 2**64, so a deletion divides what follows by BASE.
    """
    c = mix64(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(c)
    power = np.full(n, BASE, dtype=np.uint64)
    if n:
        power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power, dtype=np.uint64)])
    keys = [sums[-1:]]
    for gone in range(1, min(edits, n) + 1):
        at = np.arange(n)[:, None] if gone == 1 else np.array(list(itertools.combinations(range(n), gone)))
        key = sums[at[:, 0]]
        for k in range(gone):
            inverse = np.uint64(pow(INVERSE, k + 1, 1 << 64))
            end = sums[at[:, k + 1]] if k + 1 < gone else sums[-1]
            key = key + (end - sums[at[:, k] + 1]) * inverse
        keys.append(key)
    return np.unique(np.concatenate(keys))


ENTRY = np.dtype([("key", "<u8"), ("line", "<i8")])


def _emit(buckets: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines = b.column(0).to_numpy(), b.column(1).to_pylist()
            at = 0
            while at < len(ids):  # about a million keys at a time
                end, size = at, 0
                while end < len(ids) and (size < 1_000_000 or end == at):
                    size += (len(lines[end]) + 1) ** edits
                    end += 1
                keys = [deletion_keys(x, edits) for x in lines[at:end]]
                e = np.empty(sum(map(len, keys)), dtype=ENTRY)
                e["key"], e["line"] = np.concatenate(keys), np.repeat(ids[at:end], [len(k) for k in keys])
                to = (e["key"] >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                e, to = e[order], to[order]
                starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                ends = np.r_[starts[1:], len(to)]
                yield batch_of({"bucket": (to[starts].astype(np.int64), pa.int64()), "entries": ([e[s:t].tobytes() for s, t in zip(starts, ends)], pa.binary())})
                at = end

    return run


def _match(table: pa.Table) -> pa.Table:
    e = np.frombuffer(b"".join(table.column("entries").to_pylist()), dtype=ENTRY)
    order = np.argsort(e["key"], kind="stable")
    key, line = e["key"][order], e["line"][order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    found = [np.empty((0, 2), dtype=np.int64)]
    for size in np.unique(sizes[sizes > 1]):
        at = starts[sizes == size]
        block = np.sort(line[at[:, None] + np.arange(size)], axis=1)
        i, j = np.triu_indices(size, 1)
        step = max(1, 2_000_000 // len(i))
        for s in range(0, len(block), step):
            pairs = np.stack([block[s : s + step, i].ravel(), block[s : s + step, j].ravel()], axis=1)
            found.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
    both = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


@F.pandas_udf(StringType())
def _rebuild(text: pd.Series, at: pd.Series, h: pd.Series) -> pd.Series:
    def one(t, kept_at, kept_h):
        if t is None:
            return None
        kept = set(zip(kept_at, kept_h)) if kept_at is not None else set()
        out = []
        for i, x in enumerate(t.split("\n")):
            if not x.strip(SPACE) or (i, _signed(xxhash.xxh64_intdigest(x.encode(), seed=42))) in kept:
                out.append(x)
        return "\n".join(out)

    return pd.Series([one(*r) for r in zip(text, at, h)], dtype=object)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _places(base: DataFrame) -> DataFrame:
    """Every line that isn't blank: doc_id, line_no, line, its hashes and its length."""
    lines = base.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(~blank(F.col("line")))
    return lines.select("doc_id", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("n"))


def _first(doc_id: Column, line_no: Column) -> list[Column]:
    return [doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), line_no.alias("line_no")]


def maybe_among(keys: DataFrame, key: str, value: Column) -> Column:
    """Whether ``value`` may be among the keys: a Bloom filter of one hash, of 16 bits a key and 8 MB at most.

    Beyond four million keys it only lets more through; nothing that is among the keys is ever kept out.
    """
    words = 1 << min(20, max(4, math.ceil(math.log2(max(1, keys.count()) / 4))))
    word = lambda h: F.pmod(h, F.lit(words))
    bit = lambda h: F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")
    h = F.xxhash64(key)
    ones = keys.select(word(h).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}), 40) & 63 as int))").alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits"))
    every = keys.sparkSession.range(words).join(ones, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("table")).scalar()
    h = F.xxhash64(value)
    return F.getbit(F.get(table, word(h).cast("int")), bit(h)) == 1


def near_lines(base: DataFrame, distinct: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line ``edits`` edits away at most."""
    parts = distinct.where(F.size("f.parts") > 0).select("h1", F.explode(F.array_distinct("f.parts")).alias("part"))
    shared = parts.groupBy("part").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("part")
    flagged = parts.join(shared, "part", "left_semi").select("h1").distinct()
    wanted = distinct.join(flagged, "h1", "left_semi").groupBy(F.col("f.doc_id").alias("w_id")).agg(F.collect_list(F.struct(F.col("f.line_no").alias("line_no"), "h1", "h2")).alias("wanted"))
    wanted = cut(wanted)
    # of the texts only those with a wanted line are shuffled, but for a few that the filter can't tell from them
    some = base.where(maybe_among(wanted, "w_id", base["doc_id"])).join(wanted.hint("shuffle_hash"), base["doc_id"].eqNullSafe(wanted["w_id"]), "left").where("wanted is not null")
    # each text is split once, behind a generator, and its wanted lines are taken by their numbers
    some = some.select("doc_id", "wanted", F.explode(F.array(F.split("text", "\n"))).alias("lines"))
    some = some.select("doc_id", F.explode(F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["line_no"].alias("line_no"), F.get("lines", w["line_no"]).alias("line")))).alias("w"))
    lines = some.where((F.xxhash64("w.line") == F.col("w.h1")) & (F.xxhash64(F.lit(1), "w.line") == F.col("w.h2"))).select("w.h1", "w.h2", "doc_id", "w.line_no", "w.line")
    lines = cut(lines.dropDuplicates(["h1", "h2"]))
    keys = lines.agg(F.sum(F.pow(F.length("line") + 1.0, F.lit(edits)))).first()[0] or 0
    buckets = max(12, math.ceil(keys / KEYS_PER_BUCKET))
    packed = lines.select("h1", "line").mapInArrow(_emit(buckets, edits), "bucket bigint, entries binary")
    pairs = packed.groupBy("bucket").applyInArrow(_match, "a bigint, b bigint").distinct()
    side = lambda x: lines.select(F.col("h1").alias(x), F.col("h2").alias(f"{x}2"), F.struct(*_first(F.col("doc_id"), F.col("line_no"))).alias(f"{x}_at"), F.col("line").alias(f"{x}_line"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    near = both.where(F.levenshtein("a_line", "b_line", edits).between(F.lit(0), F.floor(F.least(F.length("a_line"), F.length("b_line")) / max(1, min_chars))))
    later = F.col("a_at") > F.col("b_at")
    return near.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("h1"), F.when(later, F.col("a2")).otherwise(F.col("b2")).alias("h2")).distinct()


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and two columns more: n_lines and n_dropped.

    Lines are in the order of (doc_id, line number), documents without id last. A line goes if an earlier one
    is equal or at most ``max_edits`` characters' edits away, whether or not that earlier line itself stays. The
    edits are bounded in proportion too: lines of under ``min_chars`` characters for each edit must be nearer, so
    that ``}`` doesn't take ``{`` away; a line under ``min_chars`` must be equal. Lines without a visible
    character always stay and aren't counted. Long lines are compared whole. A null text stays null (0 lines); a
    document may end with an empty text. Rows that share a doc_id, null included, are versions of one document: equal
    lines at the same line number in them stay or go together, so there are no ties. An empty table gives an empty
    one. New columns that clash with those of ``docs`` get a ``_`` before. The keys of a line are as many as its
    length to the power ``max_edits``.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    n = F.col("n")
    parts_of = F.when(n >= min_chars, _parts(F.col("line"), n, max_edits)) if max_edits else F.lit(None)
    parts_of = F.coalesce(parts_of, F.array().cast("array<bigint>"))
    first = F.min(F.struct(*_first(F.col("doc_id"), F.col("line_no")), parts_of.alias("parts")))
    distinct = _places(base).groupBy("h1", "h2").agg(first.alias("f"))
    kept = distinct.join(near_lines(base, distinct, max_edits, min_chars), ["h1", "h2"], "left_anti") if max_edits else distinct
    kept = kept.groupBy(F.col("f.doc_id").alias("k_id")).agg(F.collect_list(F.struct(F.col("f.line_no").alias("at"), F.col("h1").alias("h"))).alias("k"))
    n_lines, n_dropped, k_id, k, parts = fresh(docs, "n_lines", "n_dropped", "k_id", "k", "parts")
    kept = kept.select(F.col("k_id").alias(k_id), F.col("k").alias(k))
    text = docs[f"`{text_col}`"]
    with_k = docs.join(kept.hint("shuffle_hash"), docs[f"`{id_col}`"].eqNullSafe(kept[k_id]), "left")
    # an array, so that the lines are split once: number of lines, hashes of those with their numbers
    seen = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(~blank(x), F.xxhash64(i, F.xxhash64(x)))), lambda x: x.isNotNull())
    here = F.transform(F.col(k), lambda e: F.xxhash64(e["at"], e["h"]))
    with_k = with_k.withColumn(parts, F.when(text.isNotNull(), F.struct(F.size(seen).alias("n"), F.size(F.array_intersect(seen, F.coalesce(here, F.array().cast("array<bigint>")))).alias("kept"))))
    changed = F.col(f"{parts}.n") > F.col(f"{parts}.kept")
    new = _rebuild(F.when(changed, text), F.when(changed, F.col(f"{k}.at")), F.when(changed, F.col(f"{k}.h")))
    cols = [F.when(changed, new).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return with_k.select(*cols, F.coalesce(F.col(f"{parts}.n"), F.lit(0)).alias(n_lines), F.coalesce(F.col(f"{parts}.n") - F.col(f"{parts}.kept"), F.lit(0)).alias(n_dropped))


def op2(spark, sf_dir: str) -> DataFrame:
    """``documents`` after line dedup: doc_id, text, n_lines, n_dropped."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_W = r"'\s+', '', 'g'"
OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
),
v AS (SELECT *, regexp_replace(line, {_W}) = '' AS blank FROM l),
d AS (
  SELECT line, min(doc_id * 4294967296 + line_no) AS pos, length(line) AS n FROM v WHERE NOT blank GROUP BY line
),
h AS (
  SELECT line, pos, n, m, side, CASE side WHEN 0 THEN left(line, m // 2) ELSE right(line, m // 2) END AS half
  FROM (SELECT *, unnest([n - 1, n]) AS m FROM d WHERE n >= {MIN_CHARS}), (VALUES (0), (1)) s(side)
),
p AS (
  SELECT DISTINCT a.line AS x, b.line AS y FROM h a JOIN h b ON a.m = b.m AND a.side = b.side AND a.half = b.half
  WHERE a.pos < b.pos AND abs(a.n - b.n) <= 1
),
near AS (
  SELECT DISTINCT y AS line FROM (SELECT x, y, length(x) AS nx, length(y) AS ny FROM p)
  WHERE CASE WHEN nx = ny THEN len(list_filter(range(1, nx + 1), lambda i: x[i] <> y[i])) = 1
             WHEN nx > ny THEN len(list_filter(range(0, nx), lambda i: x[1:i] || x[i + 2:] = y)) > 0
             ELSE len(list_filter(range(0, ny), lambda i: y[1:i] || y[i + 2:] = x)) > 0 END
),
k AS (
  SELECT v.doc_id, v.line_no, v.line, v.blank, v.blank OR (d.pos = v.doc_id * 4294967296 + v.line_no AND near.line IS NULL) AS keep
  FROM v LEFT JOIN d ON d.line = v.line LEFT JOIN near ON near.line = v.line
),
g AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE keep), '') AS text,
         CAST(count(*) FILTER (WHERE NOT blank) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE NOT keep) AS INTEGER) AS n_dropped
  FROM k GROUP BY doc_id
)
SELECT o.doc_id, g.text, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped FROM documents o LEFT JOIN g USING (doc_id)
"""
