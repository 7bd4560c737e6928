"""SimHash near-dedup with Golay-code fuzzy hashing.

Each document has a fingerprint of four 23-bit segments (SimHash of its set of words) and 64 more bits
(SimHash of its word pairs). The binary Golay code (23, 12) is perfect: every 23-bit segment lies within
3 bits of exactly one codeword. A segment gets as keys the message indices of all codewords within 4 bits:
6 of them if the nearest is 3 bits away, else that one. Two segments that differ in at most 2 bits always
share a key. Of four segments with at most 8 differing bits at least two differ in at most 2, so two
fingerprints that near share a key of some *pair* of segments (24 bits). The 92 bits are cut into four segments
twice, as they come and every fourth, so that pairs further apart have a second chance. Candidates are verified
on all bits; groups are connected components, of which each key contributes no more links than it has records.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, connected, cut, mix64, pick, slices, words

SEGMENTS, SEGMENT_BITS = 4, 23
#: Pairs of segments, of the four in a row and of the four of every fourth bit.
PAIRS = [(k + i, k + j) for k in (0, SEGMENTS) for i, j in itertools.combinations(range(SEGMENTS), 2)]
#: Runs of equal keys that are longer are linked by search instead of pair by pair.
LONG_RUN = 64
MAX_BITS = 16
MAX_PAIR_BITS = 21
ENTRIES_PER_BUCKET = 300_000
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1

SIGNATURE = "doc_id bigint, lo bigint, hi bigint, pairs bigint"


def _remainder(v: int) -> int:
    for shift in range(11, -1, -1):
        if v >> (shift + 11) & 1:
            v ^= GENERATOR << shift
    return v


class Golay:
    """Tables of the code: syndromes, and by syndrome the error patterns of the codewords within 4 bits."""

    def __init__(self) -> None:
        self.syndrome = np.array([_remainder(m << 11) for m in range(4096)], dtype=np.int32)
        by: dict[int, list[int]] = {}
        unit = [_remainder(1 << b) for b in range(SEGMENT_BITS)]
        for weight in range(5):
            for at in itertools.combinations(range(SEGMENT_BITS), weight):
                s = 0
                for b in at:
                    s ^= unit[b]
                by.setdefault(s, []).append(sum(1 << b for b in at))
        self.errors = np.full((2048, 6), -1, dtype=np.int32)
        for s, patterns in by.items():
            if bin(patterns[0]).count("1") < 3:
                patterns = patterns[:1]
            self.errors[s, : len(patterns)] = patterns

    def keys(self, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, 6) message indices, and which of them exist."""
        segment = segment.astype(np.int32)
        e = self.errors[self.syndrome[segment >> 11] ^ (segment & 0x7FF)]
        return (segment[:, None] ^ e) >> 11, e >= 0


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def _majority(bits: np.ndarray) -> np.ndarray:
    return bits.sum(axis=0, dtype=np.int32) * 2 > len(bits)


def fingerprints(texts: list[str | None]) -> list[tuple[int, int, int] | None]:
    """(lo, hi, pairs) of each text: 2 x 46 bits of the words, 64 bits of the word pairs; None without a word."""
    split = [words(t) if t else [] for t in texts]
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in ws], dtype=np.int64) for ws in split]
    if not index:
        return [None] * len(texts)
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in index), dtype=np.uint8).reshape(-1, 16)
    plane = np.unpackbits(raw[:, :12], axis=1)[:, : SEGMENTS * SEGMENT_BITS]
    short = np.ascontiguousarray(raw[:, 8:]).view(np.uint64).ravel()
    weights = (1 << np.arange(46, dtype=np.uint64)).astype(np.uint64)
    out: list[tuple[int, int, int] | None] = []
    for at in ids:
        if not len(at):
            out.append(None)
            continue
        b = _majority(plane[np.unique(at)])
        h = short[at]
        h = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else mix64(h)
        p = np.packbits(_majority(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)))
        out.append((int(weights[b[:46]].sum()), int(weights[b[46:]].sum()), int(p.view(np.int64)[0])))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        prints = [f for part in slices(texts) for f in fingerprints(texts[part])]
        rows = [(i, *f) for i, f in zip(ids, prints) if f is not None and i is not None]
        yield batch_of({n: ([r[k] for r in rows], pa.int64()) for k, n in enumerate(("doc_id", "lo", "hi", "pairs"))})


def segments_of(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Four segments of the bits in a row, then four of every fourth bit."""
    mask = (1 << SEGMENT_BITS) - 1
    every = [np.zeros(len(lo), dtype=np.int64) for _ in range(SEGMENTS)]
    for k in range(SEGMENTS * SEGMENT_BITS):
        bit = (lo >> k if k < 46 else hi >> (k - 46)) & 1
        every[k % SEGMENTS] |= bit << (k // SEGMENTS)
    return [lo & mask, lo >> SEGMENT_BITS, hi & mask, hi >> SEGMENT_BITS, *every]


RECORD = np.dtype([("pair", "u1"), ("key", "<u2"), ("id", "<i8"), ("lo", "<i8"), ("hi", "<i8"), ("pairs", "<i8")])


def _emit(buckets: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = golay()
        for b in batches:
            ids, lo, hi, pairs = (b.column(k).to_numpy() for k in range(4))
            keys = [code.keys(s) for s in segments_of(lo, hi)]
            parts, where = [], []
            for p, (i, j) in enumerate(PAIRS):
                at, col = np.nonzero(keys[i][1])
                part = np.array([0] * spread)
                if spread > 1:  # also by the second segment's key, so that no bucket outgrows a task
                    kj, ok = keys[j]
                    part = np.where(ok, kj % spread, -1)
                for q in range(spread):
                    sel = slice(None) if spread == 1 else (part[at] == q).any(axis=1)
                    rows, cols = at[sel], col[sel]
                    r = np.empty(len(rows), dtype=RECORD)
                    r["pair"], r["key"], r["id"], r["lo"], r["hi"], r["pairs"] = p, keys[i][0][rows, cols], ids[rows], lo[rows], hi[rows], pairs[rows]
                    parts.append(r)
                    where.append((((p * 4096 + r["key"].astype(np.int64)) * spread + q) * 2654435761 >> 7) % buckets)
            rec, to = np.concatenate(parts), np.concatenate(where)
            order = np.argsort(to, kind="stable")
            rec, to = rec[order], to[order]
            starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.array([], dtype=int)
            ends = np.r_[starts[1:], len(to)]
            yield batch_of({"bucket": (to[starts], pa.int64()), "records": ([rec[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())})

    return run


def _pairs_in(run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs within runs of equal values of a sorted array, distance by distance."""
    left = np.flatnonzero(run[1:] == run[:-1])
    step = 1
    while len(left):
        yield left, left + step
        step += 1
        left = left[left + step < len(run)]
        left = left[run[left + step] == run[left]]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _links(members: np.ndarray, near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what chains of near(x, y) join among the members, by breadth-first search.

    A member that is reached is compared with those not yet reached only, so a crowd of near ones costs little
    more than its size.
    """
    rest, queue = members, members[:0]
    while len(rest):
        if not len(queue):
            queue, rest = rest[:1], rest[1:]
            continue
        step = max(1, 2_000_000 // len(rest))
        x, queue = queue[:step], queue[step:]
        hit = near(x[:, None], rest[None, :])
        reached = hit.any(axis=0)
        if reached.any():
            yield x[hit[:, reached].argmax(axis=0)], rest[reached]
            queue, rest = np.concatenate([queue, rest[reached]]), rest[~reached]


def near_pairs(rec: np.ndarray, max_bits: int, max_pair_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of verified pairs among the records of a bucket, as stars."""
    code = golay()
    ids, at = np.unique(rec["id"], return_index=True)
    lo, hi = rec["lo"][at], rec["hi"][at]
    pairs = rec["pairs"][at].view(np.uint64)  # bits are counted of absolute values
    local = np.searchsorted(ids, rec["id"])
    keys, who = [], []
    seg = segments_of(lo, hi)
    second = [code.keys(s) for s in seg]
    for p, (_, j) in enumerate(PAIRS):
        r = np.flatnonzero(rec["pair"] == p)
        kj, ok = second[j][0][local[r]], second[j][1][local[r]]
        n, c = np.nonzero(ok)
        keys.append((p << 24) | (rec["key"][r][n].astype(np.int64) << 12) | kj[n, c])
        who.append(local[r][n])
    key, who = np.concatenate(keys), np.concatenate(who)
    order = np.argsort(key, kind="stable")
    key, who = key[order], who[order]

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(lo[x] ^ lo[y]) + np.bitwise_count(hi[x] ^ hi[y]) <= max_bits) & (np.bitwise_count(pairs[x] ^ pairs[y]) <= max_pair_bits)

    found = []
    code_of = lambda x, y: np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    for s, n in zip(starts[sizes > LONG_RUN], sizes[sizes > LONG_RUN]):
        found += [code_of(x, y) for x, y in _links(np.unique(who[s : s + n]), near)]
    short = np.repeat(sizes <= LONG_RUN, sizes)
    key, who = key[short], who[short]
    for i, j in _pairs_in(key):
        x, y = who[i], who[j]
        ok = near(x, y)
        if ok.any():
            found.append(code_of(x[ok], y[ok]))
    if not found:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    both = np.unique(np.concatenate(found))
    a, b = _stars(both // len(ids), both % len(ids))
    return ids[a], ids[b]


def _verify(max_bits: int, max_pair_bits: int):
    def run(table: pa.Table) -> pa.Table:
        rec = np.frombuffer(b"".join(table.column("records").to_pylist()), dtype=RECORD)
        a, b = near_pairs(rec, max_bits, max_pair_bits)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lo, hi, pairs) of each document that has an id and a word."""
    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(_sign, SIGNATURE)


def near_duplicate_groups(docs: DataFrame, max_bits: int = MAX_BITS, max_pair_bits: int = MAX_PAIR_BITS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, signatures): ``members(doc_id, root)`` has the documents of groups of two and more.

    A group is a connected component of pairs that differ in at most ``max_bits`` of the 92 bits of their
    words and ``max_pair_bits`` of the 64 bits of their word pairs. ``root`` is the least doc_id, so there are no
    ties. Documents without id, text or word are in no group; rows with the same doc_id count as one document.
    Whole texts are taken, however long. An empty table has no groups.
    """
    sig = cut(signatures(docs, id_col, text_col))
    same = sig.groupBy("lo", "hi", "pairs").agg(F.min("doc_id").alias("rep"))
    n = sig.count()
    spread = 1 << max(0, math.ceil(math.log2(max(1, n * 5.3 / 4096 / ENTRIES_PER_BUCKET))))
    buckets = max(12, math.ceil(n * 5.3 * len(PAIRS) * min(spread, 5) / ENTRIES_PER_BUCKET))
    packed = same.select(F.col("rep").alias("doc_id"), "lo", "hi", "pairs").mapInArrow(_emit(buckets, spread), "bucket bigint, records binary")
    near = packed.groupBy("bucket").applyInArrow(_verify(max_bits, max_pair_bits), "a bigint, b bigint")
    exact = sig.join(same, ["lo", "hi", "pairs"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return connected(near.unionByName(exact)).withColumnRenamed("node", "doc_id"), sig


def simhash_survivors(docs: DataFrame, max_bits: int = MAX_BITS, max_pair_bits: int = MAX_PAIR_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each group the document with the least id stays.

    Documents whose id is null, or whose text is null, empty or without a word, always stay. Rows that share
    a doc_id are one document: they stay or go together. Texts are fingerprinted whole, however long. Empty
    tables give empty results; all columns of ``docs`` are returned as they are, whatever their names.
    """
    members, _ = near_duplicate_groups(docs, max_bits, max_pair_bits, id_col, text_col)
    gone = members.where("doc_id <> root").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs[f"`{id_col}`"].cast("bigint") == gone["gone"], "left_anti")


def op8(spark, sf_dir: str) -> DataFrame:
    """Survivors of ``documents``: doc_id, and the number of documents of its group (1: it was alone)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    members, _ = near_duplicate_groups(docs)
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    ids = docs.select("doc_id")
    gone = members.where("doc_id <> root").select(F.col("doc_id").alias("gone"))
    kept = ids.join(gone, ids.doc_id == gone.gone, "left_anti")
    return kept.join(sizes, kept.doc_id == sizes.root, "left").select("doc_id", F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"))
