import math
from collections import Counter

import numpy as np
import pytest

from tagweave.llm import lm_scoring as M
from tagweave.llm.common import words


def level_count(c):
    return float(M.MIDDLE[M.level(np.array([c]))[0]])


def brute(texts):
    """log2 probability of each text with exact counts, quantised."""
    one, two, n = Counter(), Counter(), 0
    for t in texts:
        ws = words(t or "")
        one["<"] += bool(ws)
        for a, b in zip(["<", *ws], ws):
            one[b] += 1
            two[a, b] += 1
            n += 1
    v = sum(1 for k in one if k != "<")
    out = []
    for t in texts:
        ws, total = words(t or ""), 0.0
        for a, b in zip(["<", *ws], ws):
            c = level_count(two[a, b])
            s = max(c - M.DISCOUNT, 0) / max(level_count(one[a]), c, 1)
            total += math.log2(s + (1 - s) * M.BACKOFF * (level_count(one[b]) + 1) / (n + v + 1))
        out.append((total, len(ws)))
    return out


def test_filter_never_loses_a_count_and_rarely_raises_one():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    c = rng.integers(1, 500, len(h))
    bits, raw = M.build(h, c)
    n = np.zeros(len(h), dtype=np.int64)
    got = M.read_levels(h, np.frombuffer(raw, dtype=np.uint8), n.astype(np.uint64) + np.uint64(bits), n)
    assert (got >= M.level(c)).all() and (got > M.level(c)).mean() < 0.1
    other = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    n = np.zeros(len(other), dtype=np.int64)
    assert (M.read_levels(other, np.frombuffer(raw, dtype=np.uint8), n.astype(np.uint64) + np.uint64(bits), n) > 0).mean() < 0.1


def test_counts_travel_unchanged():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    c = rng.choice([1, 2, 254, 255, 256, 10**9], len(h))
    a, b = M.unpack(M.pack(h, c))
    assert (a == h).all() and (b == c).all()
    merged = M.merge([(h, c), (h[::2], c[::2])])
    assert (merged[0] == h).all() and merged[1].sum() == c.sum() + c[::2].sum()
    one = M.unpack(M.pack(h[:1], c[:1]))
    assert one[0][0] == h[0]


def brute_of_order(texts, order):
    """log2 probability of each text with exact counts of 1-grams to order-grams, quantised."""
    count = Counter()
    for t in texts:
        ws = words(t or "")
        count[("<",)] += bool(ws)
        padded = ["<"] * (order - 1) + ws
        for i in range(order - 1, len(padded)):
            for n in range(1, order + 1):
                count[tuple(padded[i - n + 1 : i + 1])] += 1
    tokens = sum(len(words(t or "")) for t in texts)
    v = sum(len(k) == 1 for k in count) - 1
    out = []
    for t in texts:
        ws, total = words(t or ""), 0.0
        padded = ["<"] * (order - 1) + ws
        for i in range(order - 1, len(padded)):
            p = (level_count(count[padded[i],]) + 1) / (tokens + v + 1)
            for n in range(2, order + 1):
                gram = tuple(padded[i - n + 1 : i + 1])
                # what is before a text is one begin mark
                history = ("<",) if i == order - 1 else gram[:-1]
                c = level_count(count[gram])
                s = max(c - M.DISCOUNT, 0) / max(level_count(count[history]), c, 1)
                p = s + (1 - s) * M.BACKOFF * p
            total += math.log2(p)
        out.append((total, len(ws)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_orders_against_brute_force(spark, sf, monkeypatch, order):
    """With a filter so large that nothing missing is found in it, scores are those of exact quantised counts."""
    monkeypatch.setattr(M, "BITS_PER_ENTRY", 400)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    h = M.counted(iter([M.pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})]), order)
    (c,) = h
    bits, field = M.build(c.keys[c.counts > 0], c.counts[c.counts > 0])
    word = ((c.keys & M._TAG) == 1) & (c.keys != M.begin_key())
    model = M.Model(order, 1, int(c.counts[word].sum()), int(word.sum()))
    read = lambda x: M.read_levels(x, np.frombuffer(field, dtype=np.uint8), np.full(len(x), bits, dtype=np.uint64), np.zeros(len(x), dtype=np.int64))
    logs = model.score(c.sizes, [read(g) for g in c.grams], int(read(np.array([M.begin_key()]))[0]))
    ends = np.cumsum(c.sizes)
    got = np.concatenate([[0.0], np.cumsum(logs)])
    got = got[ends] - got[ends - c.sizes]
    want = brute_of_order([r[1] for r in rows], order)
    assert np.allclose(got, [w for w, _ in want], atol=1e-6)


@pytest.mark.parametrize("most", [M.BROADCAST_BYTES, 0])
def test_against_brute_force(spark, sf, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r.doc_id: r for r in M.lm_scores(docs, broadcast_bytes=most).collect()}
    assert len(got) == len(rows)
    errors = [abs(got[r.doc_id].log2_prob - want) / n for r, (want, n) in zip(rows, brute([r.text for r in rows])) if n]
    assert np.mean(errors) < 0.15 and all(got[r.doc_id].n_tokens == n for r, (_, n) in zip(rows, brute([r.text for r in rows])))


def test_broadcast_and_join_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda r: (r.doc_id, r.n_tokens, round(r.log2_prob or 0, 6))
    for order in (1, 2, 3):
        assert sorted(map(key, M.lm_scores(docs, order=order).collect())) == sorted(map(key, M.lm_scores(docs, order=order, broadcast_bytes=0).collect()))


@pytest.mark.parametrize("most", [M.BROADCAST_BYTES, 0])
def test_edges(spark, most):
    df = spark.createDataFrame([(1, None, 0), (None, "a b", 0), (2, "", 0), (2, "...", 0), (3, "a b", 0), (3, "a b", 0), (4, "long word " * 50_000, 0)], "doc_id int, text string, part int")
    rows = M.lm_scores(df, broadcast_bytes=most).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 2), (1, 0), (2, 0), (2, 0), (3, 2), (3, 2), (4, 100_000)]
    assert all((r.log2_prob is None) == (r.n_tokens == 0) == (r.perplexity is None) for r in rows)
    assert M.lm_scores(df.limit(0), broadcast_bytes=most).collect() == []
    flat = {r.doc_id: r.log2_prob for r in M.lm_scores(df, train=df.limit(0), broadcast_bytes=most).collect()}
    assert flat[3] == 0.0 or flat[3] < 0


def test_beyond_the_broadcast_n_grams_meet_their_shard_once(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = M.lm_scores(docs, broadcast_bytes=0)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1
    key = lambda r: (r.doc_id, r.n_tokens, round(r.log2_prob or 0, 6))
    want = sorted(map(key, M.lm_scores(docs).collect()))
    assert sorted(map(key, scored.collect())) == want
    mixed = docs.repartition(7)  # rows that a shuffle brings are fixed first
    assert sorted(map(key, M.lm_scores(mixed, broadcast_bytes=0).collect())) == want


def test_slices_and_shards_of_any_size(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).unionByName(spark.read.parquet(f"{sf}/documents.parquet").limit(40))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r.doc_id, round(r.log2_prob or 0, 6))
    rows = M.counted(iter([M.pa.RecordBatch.from_pydict({"doc_id": [t[0] for t in texts], "text": [t[1] for t in texts]})]), 2)
    whole = list(rows)
    monkeypatch.setattr(M, "FLUSH", 100)
    monkeypatch.setattr("tagweave.llm.common.slices.__defaults__", (200,))
    parts = list(M.counted(iter([M.pa.RecordBatch.from_pydict({"doc_id": [t[0] for t in texts], "text": [t[1] for t in texts]})]), 2))
    assert len(whole) == 1 and len(parts) > 10
    h, c = M.merge([(p.keys, p.counts) for p in parts])
    assert (h == whole[0].keys).all() and (c == whole[0].counts).all() and sum((p.ids for p in parts), []) == whole[0].ids
    for p in parts:
        assert all((p.keys[a] == g).all() for a, g in zip(p.at(), p.grams))


def test_another_table_s_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = docs.where("doc_id % 3 = 0")
    key = lambda r: (r.doc_id, round(r.log2_prob or 0, 6))
    assert sorted(map(key, M.lm_scores(docs, train).collect())) == sorted(map(key, M.lm_scores(docs, train, broadcast_bytes=0).collect()))


def test_a_shard_probes_each_n_gram_once(monkeypatch):
    """However many slices ask for it; what they get is what each would have read by itself."""
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    asked = [np.sort(rng.choice(h, n, replace=False)) for n in (1500, 1, 700, 1500)]
    counts = [rng.integers(1, 300, len(a)) for a in asked]
    slices = [7, 8, None, 9]  # one only counts
    table = M.pa.table({"slice": M.pa.array(slices, M.pa.int64()), "bucket": M.pa.array([3] * 4, M.pa.int64()), "payload": M.pa.array([M.pack(a, c) for a, c in zip(asked, counts)], M.pa.binary())})
    probed, read = [], M.read_levels
    monkeypatch.setattr(M, "read_levels", lambda h, *rest: probed.append(len(h)) or read(h, *rest))
    got = {r["slice"]: r for r in M._answer(table).to_pylist()}
    assert sum(probed) == len(np.unique(np.concatenate(asked)))
    bits, field, n_words, tokens = M._built(list(zip(asked, counts)))
    assert (got[None]["words"], got[None]["tokens"]) == (n_words, tokens) and set(got) == {None, 7, 8, 9}
    for s, a in zip(slices, asked):
        n = np.zeros(len(a), dtype=np.int64)
        if s is not None:
            assert got[s]["levels"] == read(a, np.frombuffer(field, dtype=np.uint8), n.astype(np.uint64) + np.uint64(bits), n).astype(np.uint8).tobytes()


def test_places_are_those_of_a_search():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 1000):
        for most in (n, 1 << 20, (1 << 64) - 1):  # close together, too
            keys = np.unique(rng.integers(0, most, n, dtype=np.uint64, endpoint=True))
            h = rng.choice(keys, 3 * n)
            assert (M.places(keys, h) == np.searchsorted(keys, h)).all()
    assert len(M.places(keys, keys[:0])) == 0
