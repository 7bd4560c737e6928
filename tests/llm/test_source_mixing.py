import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tagweave.llm import source_mixing as M


def test_permutations():
    for n in (1, 2, 3, 5, 64, 100, 1025):
        for key in (0, 1, 99):
            assert sorted(M.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    assert not (M.permuted(np.arange(100), np.full(100, 100), np.full(100, 1)) == M.permuted(np.arange(100), np.full(100, 100), np.full(100, 2))).all()


def packed(docs, size):
    """Tokens in each block of each source: {(source, block): Counter of tokens}, and block counts, by multiset."""
    tokens = defaultdict(list)
    for source, text in docs:
        tokens[source] += re.findall(r"\S+", text or "")
    return {s: (-(-len(t) // size), Counter(t)) for s, t in tokens.items() if t}


def test_packing_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # weights and slots such that every block comes exactly once: one source alone, as many slots as blocks
    rows = docs.collect()
    want = packed([(r.source, r.text) for r in rows], 100)
    for source in sorted(want)[:3]:
        n, tokens = want[source]
        out = M.mix_sources(docs, weights={source: 1.0}, block_tokens=100, slots=n, shard_slots=7).collect()
        assert sorted(r.block for r in out) == list(range(n)) and {r.source for r in out} == {source}
        assert sum((Counter(r.text.split()) for r in out), Counter()) == tokens
        assert sorted(r.n_tokens for r in out)[1:] == [100] * (n - 1) and all(len(r.text.split()) == r.n_tokens for r in out)
        assert [(r.shard, r.slot) for r in sorted(out, key=lambda r: (r.shard, r.slot))] == [(k // 7, k % 7) for k in range(n)]
        # documents follow each other whole: the blocks in order spell them one after another
        whole = "".join(r.text for r in sorted(out, key=lambda r: r.block))
        for r in rows:
            if r.source == source and r.text.strip():
                assert r.text.strip() + "\n" in whole


def test_counts_follow_the_weights_and_passes_are_balanced(spark):
    docs = spark.createDataFrame([(k, "w " * 50, "abc"[k % 3], "en") for k in range(60)], "doc_id int, text string, source string, lang string")
    out = M.mix_sources(docs, weights={"a": 0.7, "b": 0.3}, block_tokens=10, slots=3000, shard_slots=100).collect()
    share = Counter(r.source for r in out)
    assert len(out) == 3000 and set(share) == {"a", "b"} and abs(share["a"] / 3000 - 0.7) < 0.04
    per = Counter((r.shard, r.source) for r in out)
    assert len({per[k, "a"] for k in range(30)}) > 3  # drawn, not fixed
    times = Counter((r.source, r.block) for r in out)
    for s in "ab":
        n = [times[s, b] for b in range(100)]
        assert max(n) - min(n) <= 1
    again = M.mix_sources(docs, weights={"a": 0.7, "b": 0.3}, block_tokens=10, slots=3000, shard_slots=100).collect()
    assert sorted(map(tuple, [(r.shard, r.slot, r.text) for r in out])) == sorted(map(tuple, [(r.shard, r.slot, r.text) for r in again]))


def test_default_weights_against_brute_force(spark, sf):
    """The registered query's parameters but for smaller blocks: every slot against a mixture made row by row."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang")
    out = M.mix_sources(docs, block_tokens=50, shard_slots=32).collect()
    key = {r.source: r.key for r in docs.select("source", M.source_key(F.col("source")).alias("key")).distinct().collect()}
    mass = Counter()
    for r in docs.collect():
        mass[r.source] += len(re.findall(r"\S+", r.text))
    order = sorted((s for s in mass if mass[s]), key=lambda s: key[s])
    blocks = {s: -(-mass[s] // 50) for s in order}
    w = np.array([mass[s] ** M.TEMPERATURE for s in order])
    slots = sum(blocks.values())
    assert len(out) == slots == len({(r.shard, r.slot) for r in out})
    want, drawn = {}, Counter()
    for shard in range(-(-slots // 32)):
        size = min(32, slots - shard * 32)
        at = 0
        for s, n in zip(order, np.random.Generator(np.random.PCG64([M.SEED, shard])).multinomial(size, w / w.sum())):
            for i in range(n):
                (slot,) = M.permuted(np.array([at]), np.array([size]), M.mix64(np.array([shard], dtype=np.uint64) + np.uint64(M.SEED)))
                j = drawn[s]
                epoch = j // blocks[s]
                seed = M.mix64(np.array([key[s]], dtype=np.int64).view(np.uint64) ^ M.mix64(np.array([epoch], dtype=np.uint64) + np.uint64(M.SEED)))
                want[shard, int(slot)] = (s, epoch, int(M.permuted(np.array([j % blocks[s]]), np.array([blocks[s]]), seed)[0]))
                at += 1
                drawn[s] += 1
    assert {(r.shard, r.slot): (r.source, r.epoch, r.block) for r in out} == want
    texts = {(r.source, r.block): r.text for r in out}
    assert all(r.text == texts[r.source, r.block] for r in out)


def test_repeated_rows_count_as_often_as_they_come(spark):
    rows = [(1, "a b c", "q", "x")] * 5 + [(2, "d e", "q", "x"), (None, "f", None, None), (None, "f", None, None)]
    out = M.mix_sources(spark.createDataFrame(rows, "doc_id int, text string, source string, lang string"), block_tokens=4, slots=5, weights={"q": 1}).collect()
    assert sorted(r.block for r in out) == [0, 1, 2, 3, 4]
    assert sum((Counter(r.text.split()) for r in out), Counter()) == Counter("abc" * 5 + "de")
    whole = "".join(r.text for r in sorted(out, key=lambda r: r.block))
    assert "a b c\n" * 5 in whole
    other = M.mix_sources(spark.createDataFrame(rows, "doc_id int, text string, source string, lang string"), block_tokens=4, slots=1, weights={None: 1}).collect()
    assert [r.text for r in other] == ["f\nf\n"]


def test_edges(spark):
    cols = "doc_id bigint, text string, lang string, source string, Block int"
    df = spark.createDataFrame([(1, "a b c", "x", "q", 5), (1, "a b c", "x", "q", 5), (None, " d e ", None, None, 5), (2, None, None, "q", 5), (3, " \n", "x", "q", 5), (4, "z z " * 30_000, "x", "long", 5)], cols)
    out = M.mix_sources(df, block_tokens=2, slots=2000, weights={"q": 1, None: 1}).collect()
    texts = {(r.source, r.block): r.text for r in out}
    assert texts == {("q", 0): "a b ", ("q", 1): "c\na ", ("q", 2): "b c\n", (None, 0): "d e\n"}
    assert {tuple(r.doc_ids) for r in out} == {(1,), (None,)}
    assert sum(r.n_tokens for r in M.mix_sources(df, block_tokens=1000, weights={"long": 1}, slots=30).collect()) == 30_000
    assert M.mix_sources(df.limit(0)).collect() == []
    assert M.mix_sources(df, weights={"nowhere": 1.0}).collect() == []


def test_tokens_are_counted_without_patterns(spark, sf):
    texts = [None, "", " ", "a", " a", "a ", "\u00a0", "a\vb\fc\rd\te\nf  g", "é\u2028ü\u0085 ñ", "x" * 100_000 + " y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [r[0] or 0 for r in df.select(F.regexp_count("text", F.lit(r"\S+"))).collect()]
    assert [M.count_tokens(t) for t in M.pa.array(texts, M.pa.string())] == want
