"""Language-model scores from a log-frequency Bloom filter.

N-grams of all documents are counted. Counts are quantised to levels q (level j starts at about BASE**(j - 1)),
and an n-gram of level q is put into a Bloom filter as (n-gram, 1) ... (n-gram, q). A count is read back by probing
(n-gram, 1), (n-gram, 2), ... until one is missing. Probabilities are interpolated from the counts so read.

The filter is built in shards by hash range, in parallel. While all shards together are bound to be small they are
broadcast and each worker scores its documents alone. Beyond that nothing is broadcast: what is counted in a slice of
documents is also what the slice asks for, so the task that builds a shard answers all that was counted into it, and
the levels go back to the slices. The n-grams are shuffled once in either way, and the bits, and so the scores, are the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, mix64, pick, shuffle_parts, slices, words, written

ORDER = 2
BASE = 1.5
HASHES = 4
BITS_PER_ENTRY = 5.8  # HASHES / ln 2: one probe in 16 of what is missing is positive
DISCOUNT = 0.6
BACKOFF = 0.4
BROADCAST_BYTES = 128 << 20
FLUSH = 3_000_000
CHARS_PER_SHARD = 16_000_000

_TAG = np.uint64(3)
_BEGIN = np.uint64(0x5851F42D4C957F2D)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_32 = np.uint64(32)


def level_starts(base: float = BASE) -> np.ndarray:
    """The least count of each level, to 2**62."""
    out = [1]
    x = 1.0
    while out[-1] < 1 << 62:
        x *= base
        if math.ceil(x) > out[-1]:
            out.append(math.ceil(x))
    return np.array(out, dtype=np.int64)


STARTS = level_starts()
#: What a level is read back as: the middle of its counts; 0 for level 0.
MIDDLE = np.concatenate([[0.0], (STARTS[:-1] + STARTS[1:] - 1) / 2, [float(STARTS[-1])]])


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STARTS, counts, side="right")


# -- n-grams


class Tokens(NamedTuple):
    """Tokens of a batch of texts: their hashes, the number of each text's, and for each token its number in ``vocab``."""

    hashes: np.ndarray
    sizes: np.ndarray
    vocab: np.ndarray
    at: np.ndarray


def tokens_of(texts: list[str | None]) -> Tokens:
    split = [words(t) if t else [] for t in texts]
    sizes = np.array([len(ws) for ws in split], dtype=np.int64)
    index = dict.fromkeys(chain.from_iterable(split))
    vocab = np.array([xxhash.xxh3_64_intdigest(w) for w in index], dtype=np.uint64)
    index = dict(zip(index, range(len(index))))
    at = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum()))
    return Tokens(vocab[at] if len(at) else np.zeros(0, np.uint64), sizes, vocab, at)


def ngrams(t: Tokens, order: int) -> list[np.ndarray]:
    """Tagged hashes of the 1-grams, 2-grams, ... that end at each token; what is before a text is one begin mark."""
    first = np.cumsum(t.sizes) - t.sizes
    out = []
    h = mix64(t.hashes)
    out.append((h & ~_TAG) | np.uint64(1))
    into = np.arange(len(t.hashes)) - np.repeat(first, t.sizes)
    for n in range(2, order + 1):
        back = n - 1
        earlier = np.empty_like(t.hashes)
        earlier[back:] = t.hashes[: max(0, len(t.hashes) - back)]
        earlier[into < back] = _BEGIN
        h = mix64(h * _A + earlier * _B + np.uint64(n))
        out.append((h & ~_TAG) | np.uint64(n))
    return out


def begin_key() -> np.uint64:
    return (mix64(np.array([_BEGIN]))[0] & ~_TAG) | np.uint64(1)


# -- counting: (bucket, payload) with sorted distinct hashes, and their counts


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _32) * np.uint64(buckets)) >> _32


def pack(h: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as differences of as few bytes as the largest takes, and counts of 1 byte (255: see after)."""
    d = np.diff(h, prepend=np.uint64(0))
    first, d = int(d[0]), d[1:]
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<i8")
    head = np.array([len(h), width, first], dtype="<u8").tobytes()
    return head + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes() + small.tobytes() + large.tobytes()


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, first = (int(x) for x in np.frombuffer(b, dtype="<u8", count=3))
    d = np.zeros((n - 1, 8), dtype=np.uint8)
    d[:, :width] = np.frombuffer(b, dtype=np.uint8, count=(n - 1) * width, offset=24).reshape(-1, width)
    h = np.cumsum(np.concatenate([np.array([first], dtype=np.uint64), d.view("<u8").ravel()]), dtype=np.uint64)
    at = 24 + (n - 1) * width
    counts = np.frombuffer(b, dtype=np.uint8, count=n, offset=at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(b, dtype="<i8", offset=at + n)
    return h, counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of counts by hash, sorted by hash; and for each hash of the parts, one after another, its place there."""
    h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")  # parts are sorted runs
    h, c = h[order], c[order]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, dtype=bool)
    at = np.empty(len(h), dtype=np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    starts = np.flatnonzero(new)
    return h[starts], np.add.reduceat(c, starts) if len(starts) else c, at


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts by hash, sorted by hash."""
    return merged(parts)[:2]


def places(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each of ``h`` is in ``keys`` (sorted hashes, of which all of ``h`` are some): by the first bits, then step by step."""
    bits = max(1, len(keys).bit_length())
    shift = np.uint64(64 - bits)
    at = np.concatenate([[0], np.cumsum(np.bincount((keys >> shift).view(np.int64), minlength=1 << bits))])[(h >> shift).view(np.int64)]
    todo = np.flatnonzero(keys[at] != h)
    while len(todo):
        at[todo] += 1
        todo = todo[keys[at[todo]] != h[todo]]
    return at


class Counted(NamedTuple):
    """Documents that are counted together: ids, tokens of each, their distinct n-grams (sorted) and how often they come."""

    ids: list
    sizes: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    grams: list[np.ndarray]  # by order: the n-gram that ends at each token

    def at(self) -> list[np.ndarray]:
        return [places(self.keys, g) for g in self.grams]


def counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[Counted]:
    """(doc_id, text) in slices of about ``FLUSH`` n-grams; the begin mark, as a history, is among them."""

    def flush() -> Counted:
        each = [np.concatenate(g) for g in grams]
        n = np.concatenate(sizes)
        keys, counts = np.unique(np.concatenate(each), return_counts=True)
        begin = begin_key()
        at = int(np.searchsorted(keys, begin))
        return Counted(ids, n, np.insert(keys, at, begin), np.insert(counts, at, (n > 0).sum()), each)

    ids, sizes, grams, size = [], [], [[] for _ in range(order)], 0
    for b in batches:
        own, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for part in slices(texts):
            t = tokens_of(texts[part])
            ids += own[part]
            sizes.append(t.sizes)
            for held, g in zip(grams, ngrams(t, order)):
                held.append(g)
            size += len(t.hashes) * order
            if size >= FLUSH:
                yield flush()
                ids, sizes, grams, size = [], [], [[] for _ in range(order)], 0
    if ids:
        yield flush()


def _identified(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, Counted]]:
    """Slices with a number that their place and their n-grams give."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() << 24
    for n, c in enumerate(counted(batches, order)):
        yield xxhash.xxh3_64_intdigest(c.keys.tobytes(), seed=task + n) >> 1, c


def _count(order: int, buckets: int, ask: bool = False, count: bool = True):
    """(doc_id, text) -> n-grams with their counts, by slice (null: it asks for nothing) and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_, c in _identified(batches, order):
            to = bucket_of(c.keys, buckets)
            starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            ends = np.r_[starts[1:], len(to)]
            n = c.counts if count else np.zeros_like(c.counts)
            yield batch_of({"slice": ([slice_ if ask else None] * len(starts), pa.int64()), "bucket": (to[starts].astype(np.int64), pa.int64()), "payload": ([pack(c.keys[s:e], n[s:e]) for s, e in zip(starts, ends)], pa.binary())})

    return run


COUNTED = "slice bigint, bucket bigint, payload binary"


# -- the filter


def positions(h: np.ndarray, j: int, k: int, bits: np.ndarray) -> np.ndarray:
    """Bit k of (n-gram, level j) in shards of ``bits`` bits."""
    x = mix64(h + np.uint64(j * int(_A) & (1 << 64) - 1))
    step = (x << _32 | x >> _32) * _B | np.uint64(1)
    return (((x + np.uint64(k) * step) >> _32) * bits) >> _32


def build(h: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(number of bits, bytes) of the shard that holds these n-grams."""
    q = level(counts)
    bits = max(64, int(q.sum() * BITS_PER_ENTRY))
    assert bits < 1 << 32, "shards are far smaller, as their number follows the text"
    field = np.zeros(bits, dtype=np.uint8)
    size = np.uint64(bits)
    j = 1
    while len(h):
        for k in range(HASHES):
            field[positions(h, j, k, size)] = 1
        j += 1
        on = q >= j
        h, q = h[on], q[on]
    return bits, np.packbits(field, bitorder="little").tobytes()


def read_levels(h: np.ndarray, field: np.ndarray, bits: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Levels by probing (n-gram, 1), (n-gram, 2), ...; bits and offset (in bytes) of each n-gram's shard."""
    out = np.zeros(len(h), dtype=np.int64)
    at = np.arange(len(h))
    j = 1
    while len(at):
        x = mix64(h + np.uint64(j * int(_A) & (1 << 64) - 1))
        step = (x << _32 | x >> _32) * _B | np.uint64(1)
        for k in range(HASHES):
            p = (x >> _32) * bits >> _32
            hit = (field[offset + (p >> np.uint64(3)).view(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).view(bool)
            if k < HASHES - 1:
                x = x + step
            if not hit.all():
                at, h, bits, offset = at[hit], h[hit], bits[hit], offset[hit]
                if k < HASHES - 1:
                    x, step = x[hit], step[hit]
        out[at] = j
        j += 1
    return out


def _shard(table: pa.Table) -> pa.Table:
    bits, field, words, tokens = _built([unpack(b) for b in table.column("payload").to_pylist()])
    row = {"bucket": table.column("bucket")[0].as_py(), "bits": bits, "field": field, "words": words, "tokens": tokens}
    return pa.table({k: [v] for k, v in row.items()}, schema=pa.schema([("bucket", pa.int64()), ("bits", pa.int64()), ("field", pa.binary()), ("words", pa.int64()), ("tokens", pa.int64())]))


def _built(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, bytes, int, int]:
    """(bits, field) of a shard, and how many distinct words and tokens were counted into it."""
    return _filled(*merge(parts))


def _filled(h: np.ndarray, c: np.ndarray) -> tuple[int, bytes, int, int]:
    h, c = h[c > 0], c[c > 0]
    word = ((h & _TAG) == 1) & (h != begin_key())
    return *build(h, c), int(word.sum()), int(c[word].sum())


def _answer(table: pa.Table) -> pa.Table:
    """All n-grams of a shard -> levels of those that each slice asks for, in their order; and a row of totals.

    Each distinct n-gram is probed once, whatever the number of slices that ask for it.
    """
    parts = [unpack(b) for b in table.column("payload").to_pylist()]
    sizes = np.array([len(h) for h, _ in parts], dtype=np.int64)
    h, counts, at = merged(parts)
    del parts
    bits, field, words, tokens = _filled(h, counts)
    n = np.zeros(len(h), dtype=np.int64)
    levels = read_levels(h, np.frombuffer(field, dtype=np.uint8), n.astype(np.uint64) + np.uint64(bits), n).astype(np.uint8)[at].tobytes()
    ends = np.cumsum(sizes).tolist()
    slices_, out = [None], [None]
    for slice_, start, end in zip(table.column("slice").to_pylist(), [0, *ends], ends):
        if slice_ is not None:
            slices_.append(slice_)
            out.append(levels[start:end])
    rest = [None] * (len(out) - 1)
    return pa.table({"slice": pa.array(slices_, pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int64()), "levels": pa.array(out, pa.binary()), "words": pa.array([words, *rest], pa.int64()), "tokens": pa.array([tokens, *rest], pa.int64())})


SHARD = "bucket bigint, bits bigint, field binary, words bigint, tokens bigint"
ANSWER = "slice bigint, bucket bigint, levels binary, words bigint, tokens bigint"


class Model(NamedTuple):
    order: int
    buckets: int
    tokens: int
    words: int

    def score(self, sizes: np.ndarray, levels: list[np.ndarray], begin: int) -> np.ndarray:
        """log2 probability of each token: discounted relative frequencies of the quantised counts, interpolated.

        ``levels``: of the 1-gram, 2-gram, ... that ends at each token; ``begin``: of the begin mark.
        P(w) = (c(w) + 1) / (N + V + 1); P(w | h) = s + (1 - s) BACKOFF P(w | h'), s = max(c(hw) - DISCOUNT, 0) / c(h).
        Counts of a history that are less than those of what follows it (both are rounded) are raised to them.
        """
        c = MIDDLE[levels[0]]
        p = (c + 1) / (self.tokens + self.words + 1)
        started = (np.cumsum(sizes) - sizes)[sizes > 0]
        for got in levels[1:]:
            history = np.empty_like(c)
            history[1:] = c[:-1]
            history[started] = MIDDLE[begin]
            c = MIDDLE[got]
            total = np.maximum(history, c)
            seen = np.where(total > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1), 0)
            p = seen + (1 - seen) * BACKOFF * p
        return np.log2(p)


def _result(ids: list, sizes: np.ndarray, logs: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(sizes)
    sums = np.concatenate([[0.0], np.cumsum(logs)])
    total = sums[ends] - sums[ends - sizes]
    none = sizes == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        ppl = np.exp2(-total / sizes)
    return batch_of({"doc_id": (ids, pa.int64()), "n_tokens": (sizes, pa.int64()), "log2_prob": (pa.array(np.where(none, 0, total), mask=none), None), "perplexity": (pa.array(np.where(none, 0, ppl), mask=none), None)})


SCORE = "doc_id bigint, n_tokens bigint, log2_prob double, perplexity double"


def _score_alone(model: Model, filter_):
    """Score with the broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, sizes, offsets = filter_.value
        field = np.frombuffer(raw, dtype=np.uint8)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in slices(texts):
                t = tokens_of(texts[part])
                read = lambda h: read_levels(h, field, sizes[(w := bucket_of(h, model.buckets).astype(np.int64))], offsets[w])
                vocab = read(np.append((mix64(t.vocab) & ~_TAG) | np.uint64(1), begin_key()))
                higher = [read(h) for h in ngrams(t, model.order)[1:]]
                yield _result(ids[part], t.sizes, model.score(t.sizes, [vocab[t.at], *higher], int(vocab[-1])))

    return run


def _places(order: int):
    """(doc_id, text) -> by slice: its documents, and for each token and order the place of its n-gram among the slice's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_, c in _identified(batches, order):
            at = np.concatenate([*c.at(), np.searchsorted(c.keys, [begin_key()])]).astype("<u4")
            width = max(1, (len(c.keys).bit_length() + 7) // 8)
            packed = np.ascontiguousarray(at.view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()
            yield batch_of({"slice": ([slice_], pa.int64()), "ids": ([c.ids], pa.list_(pa.int64())), "sizes": ([c.sizes], pa.list_(pa.int64())), "keys": ([len(c.keys)], pa.int64()), "at": ([packed], pa.binary())})

    return run


def _score_with(model: Model):
    def run(answers: pa.Table, docs: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("bucket").to_numpy())
        got = answers.column("levels").to_pylist()
        levels = np.frombuffer(b"".join(got[k] for k in order), dtype=np.uint8)
        out = []
        for k in range(docs.num_rows):
            if docs.column("keys")[k].as_py() != len(levels):
                raise RuntimeError("the documents came in another order when they were read again")
            ids, sizes = docs.column("ids")[k].as_py(), np.array(docs.column("sizes")[k].as_py(), dtype=np.int64)
            width = max(1, (len(levels).bit_length() + 7) // 8)
            at = np.zeros((model.order * int(sizes.sum()) + 1, 4), dtype=np.uint8)
            at[:, :width] = np.frombuffer(docs.column("at")[k].as_py(), dtype=np.uint8).reshape(-1, width)
            q = levels[at.view("<u4").ravel()]
            out.append(_result(ids, sizes, model.score(sizes, np.split(q[:-1], model.order), int(q[-1]))))
        return pa.Table.from_batches(out) if out else pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log2_prob", pa.float64()), ("perplexity", pa.float64()))})

    return run


def repeatable(df: DataFrame) -> DataFrame:
    """``df``, checkpointed unless its rows come in the same order each time, as they do from files."""
    return cut(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def _model(order: int, buckets: int, sums: DataFrame) -> Model:
    totals = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    return Model(order, buckets, totals["tokens"], totals["words"])


def lm_scores(docs: DataFrame, train: DataFrame | None = None, order: int = ORDER, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log2_prob and perplexity of each row of ``docs`` under a model of ``train`` (None: docs).

    Tokens are runs of word characters in lower case. All tokens of all rows are counted and scored, whole texts
    however long. Rows whose text is null, empty or without a word have 0 tokens and null scores; null ids are
    returned as null; repeated rows are counted and scored as often as they come; there are no ties. Other columns are
    ignored, whatever their names. An empty table gives an empty one; an empty ``train`` gives every token the same
    probability. A filter that can't exceed ``broadcast_bytes``, by the number of characters counted, is
    broadcast; else shards answer where they are built. Scores don't depend on which.
    """
    own = pick(docs, doc_id=id_col, text=text_col)
    own = own.withColumn("doc_id", own["doc_id"].cast("bigint"))
    base = own if train is None else pick(train, text=text_col).select(F.lit(None).cast("bigint").alias("doc_id"), "text")
    chars = base.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(shuffle_parts(docs), math.ceil(chars / CHARS_PER_SHARD))
    # a token takes two characters, and an n-gram at most as many entries as it was counted
    if (chars // 2 + 1) * order * BITS_PER_ENTRY / 8 <= broadcast_bytes:
        shards = cut(base.mapInArrow(_count(order, buckets), COUNTED).groupBy("bucket").applyInArrow(_shard, SHARD))
        model = _model(order, buckets, shards)
        sizes, offsets = np.full(buckets, 8, dtype=np.uint64), np.zeros(buckets, dtype=np.int64)
        raw = bytearray(1)  # a shard without n-grams is 8 bits that aren't set
        for r in shards.select("bucket", "bits", "field").collect():
            sizes[r["bucket"]], offsets[r["bucket"]] = r["bits"], len(raw)
            raw += r["field"]
        return own.mapInArrow(_score_alone(model, docs.sparkSession.sparkContext.broadcast((bytes(raw), sizes, offsets))), SCORE)
    own = repeatable(own)
    asked = own.mapInArrow(_count(order, buckets, ask=True, count=train is None), COUNTED)
    if train is not None:
        asked = asked.unionByName(base.mapInArrow(_count(order, buckets), COUNTED))
    answers = written(asked.groupBy("bucket").applyInArrow(_answer, ANSWER), "lm-levels")
    model = _model(order, buckets, answers)
    levels = answers.where("slice is not null").select("slice", "bucket", "levels")
    places = own.mapInArrow(_places(order), "slice bigint, ids array<bigint>, sizes array<bigint>, keys bigint, at binary")
    return levels.groupBy("slice").cogroup(places.groupBy("slice")).applyInArrow(_score_with(model), SCORE)


def op7(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` under a model of themselves: doc_id, n_tokens, log2_prob, perplexity.

    The filter grows with the corpus, so it isn't broadcast here, at any size.
    """
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), broadcast_bytes=0)
