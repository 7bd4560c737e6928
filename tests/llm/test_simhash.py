import random

import numpy as np

from tagweave.llm import simhash_dedup as S
from tagweave.llm.common import connected


def test_the_code_is_perfect_and_near_segments_share_a_key():
    code = S.golay()
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 3000)
    keys, ok = code.keys(v)
    assert set(ok.sum(axis=1)) <= {1, 6}
    for k in (1, 2):
        w = v.copy()
        for _ in range(k):
            w ^= 1 << rng.integers(0, 23, len(v))
        other, ok2 = code.keys(w)
        shared = ((np.where(ok, keys, -1)[:, :, None] == np.where(ok2, other, -2)[:, None, :])).any(axis=(1, 2))
        assert shared.all()


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string")


def groups(rows, max_bits, max_pair_bits):
    """Least id of each document's group, by comparing all pairs."""
    prints = [(i, f) for i, f in zip([r[0] for r in rows], S.fingerprints([r[1] for r in rows])) if f]
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, f) in enumerate(prints):
        for j, g in prints[a + 1 :]:
            if bin(f[0] ^ g[0]).count("1") + bin(f[1] ^ g[1]).count("1") <= max_bits and bin((f[2] ^ g[2]) & (1 << 64) - 1).count("1") <= max_pair_bits:
                a_, b_ = sorted((find(i), find(j)))
                root[b_] = a_
    return {i: find(i) for i in root}


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = groups(rows, 8, S.MAX_PAIR_BITS)  # 8 bits: the search is exact
    kept = {r.doc_id for r in S.simhash_survivors(docs, max_bits=8).collect()}
    assert kept == {i for i, _ in rows if want.get(i, i) == i}
    want = groups(rows, S.MAX_BITS, S.MAX_PAIR_BITS)
    gone = {i for i in want if want[i] != i}
    kept = {r.doc_id for r in S.simhash_survivors(docs).collect()}
    assert not kept - {i for i, _ in rows} and len(gone & kept) <= 0.1 * len(gone)


def test_recall_of_candidates_by_differing_bits():
    """Random errors of 9 to 16 of the 92 bits: how many pairs share a key of two segments."""
    rng = np.random.default_rng(4)
    code = S.golay()
    n = 4000
    lo, hi = (rng.integers(0, 1 << 46, n) for _ in range(2))
    for bits, least in ((8, 1.0), (12, 0.98), (14, 0.95), (16, 0.9)):
        flip = np.argsort(rng.random((n, 92)), axis=1)[:, :bits]
        lo2, hi2 = lo.copy(), hi.copy()
        for k in range(bits):
            low = flip[:, k] < 46
            lo2[low] ^= 1 << flip[low, k]
            hi2[~low] ^= 1 << (flip[~low, k] - 46)
        shared = []
        for a, b in zip(S.segments_of(lo, hi), S.segments_of(lo2, hi2)):
            (k1, ok1), (k2, ok2) = code.keys(a), code.keys(b)
            shared.append((np.where(ok1, k1, -1)[:, :, None] == np.where(ok2, k2, -2)[:, None, :]).any(axis=(1, 2)))
        found = np.zeros(n, dtype=bool)
        for i, j in S.PAIRS:
            found |= shared[i] & shared[j]
        assert found.mean() >= least, (bits, found.mean())


def test_a_crowd_of_one_key_is_linked_as_all_pairs_would():
    rng = np.random.default_rng(5)
    x = np.sort(rng.uniform(0, 60, 700))
    near = lambda i, j: np.abs(x[i] - x[j]) < 0.1
    label = np.arange(700)
    label[1:] = np.where(np.diff(x) < 0.1, -1, label[1:])
    for k in range(1, 700):
        label[k] = label[k - 1] if label[k] < 0 else k
    order = rng.permutation(700)
    a, b = (np.concatenate(c) for c in zip(*S._links(order, near)))
    got = np.arange(700)
    nodes, root = S._stars(a, b)
    got[nodes] = root
    assert (got == label).all() and len(a) == 700 - len(set(label))


def test_a_hundred_thousand_documents_of_one_template():
    import time

    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 46, 2)
    n = 100_000
    rec = np.zeros(n, dtype=S.RECORD)
    rec["id"] = np.arange(n)
    noise = lambda k: np.bitwise_or.reduce(1 << rng.integers(0, 46, (3, n)), axis=0) * (rng.random(n) < k)
    rec["lo"], rec["hi"] = base[0] ^ noise(0.9), base[1] ^ noise(0.9)
    rec["key"] = S.golay().keys(S.segments_of(rec["lo"], rec["hi"])[0])[0][:, 0]
    rec = rec[rec["key"] == np.bincount(rec["key"]).argmax()]
    start = time.time()
    a, b = S.near_pairs(rec, S.MAX_BITS, S.MAX_PAIR_BITS)
    assert len(rec) > 20_000 and len(a) > 0.9 * len(rec) and time.time() - start < 100


def test_planted_copies_go_and_others_stay(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    docs, own = [], []
    for g in range(40):
        words = [rng.choice(vocabulary) for _ in range(250)]
        own.append(len(docs))
        docs.append((len(docs), " ".join(words)))
        for _ in range(rng.randrange(1, 4)):
            copy = [rng.choice(vocabulary) if rng.random() < 0.03 else w for w in words]
            docs.append((len(docs), " ".join(copy)))
    kept = {r.doc_id for r in S.simhash_survivors(table(spark, docs)).collect()}
    assert set(own) <= kept and len(kept - set(own)) <= 0.05 * len(docs)


def test_many_copies_and_a_spread_bucket(spark, monkeypatch):
    monkeypatch.setattr(S, "ENTRIES_PER_BUCKET", 10)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    docs = [(i, " ".join(words[:i % 5] + ["x"] + words[i % 5 + 1 :])) for i in range(100)] + [(1000 + i, " ".join(rng.choice("pqrs") + str(rng.randrange(10**6)) for _ in range(50))) for i in range(50)]
    kept = {r.doc_id for r in S.simhash_survivors(table(spark, docs)).collect()}
    assert kept == {0, *range(1000, 1050)}


def test_edges(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "...", 0), (4, text, 0), (5, text, 0), (None, text, 0), (6, "other words entirely here", 0), (6, "other words entirely here", 0), (7, "big " * 300_000, 0)], "doc_id bigint, text string, gone int")
    out = S.simhash_survivors(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == [-1, 1, 2, 3, 4, 6, 6, 7]
    assert S.simhash_survivors(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
