import re
from collections import Counter, defaultdict

import duckdb
import pytest
import sentencepiece

import corpus_pipeline as P
from tagweave.llm import quality_rules, sentencepiece_codec, source_mixing
from tagweave.llm import simhash_dedup as S

from .test_line_dedup import brute as brute_lines
from .test_simhash import groups


def brute_quality(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(r["doc_id"], r["text"]) for r in rows])
    kept = {r[0]: r[1] for r in con.sql(quality_rules.OP3_SQL).project("doc_id, text").fetchall()}
    return [r | {"text": kept[r["doc_id"]]} for r in rows if r["doc_id"] in kept]


def brute_dedup(rows):
    kept = brute_lines([(r["doc_id"], r["text"]) for r in rows])
    return [r | {"text": kept[r["doc_id"]]} for r in rows if kept[r["doc_id"]].strip()]


def brute_near(rows):
    root = groups([(r["doc_id"], r["text"]) for r in rows], S.MAX_BITS, S.MAX_PAIR_BITS)
    return [r for r in rows if root.get(r["doc_id"], r["doc_id"]) == r["doc_id"]]


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    """What each stage got and what it made of it."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows(df):
    return sorted((r.asDict() for r in df.select(*P.COLUMNS).collect()), key=lambda r: r["doc_id"])


def test_stages_keep_the_columns_of_documents(staged):
    assert [len(P.STAGES)] == [5]
    for df in staged[1:-1]:
        assert df.columns == P.COLUMNS
        assert all(r["n_chars"] == len(r["text"]) for r in rows(df))


@pytest.mark.parametrize("k,brute", [(0, brute_quality), (1, brute_dedup), (2, brute_near)])
def test_filtering_stages_against_brute_force(staged, k, brute):
    want = [r | {"n_chars": len(r["text"])} for r in brute(rows(staged[k]))]
    assert rows(staged[k + 1]) == want
    assert len(want) < staged[k].count() or k == 1  # decisions take effect


def test_mixture(staged):
    before, after = rows(staged[3]), rows(staged[4])
    tokens = defaultdict(list)
    for r in before:
        tokens[r["source"]] += re.findall(r"\S+", r["text"])
    blocks = {s: -(-len(t) // source_mixing.BLOCK_TOKENS) for s, t in tokens.items()}
    assert len(after) == sum(blocks.values()) and len({r["doc_id"] for r in after}) == len(after)
    for r in after:
        own, whole = Counter(r["text"].split()), Counter(tokens[r["source"]])
        assert all(own[t] <= whole[t] for t in own)


def test_token_ids(staged):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_FILE)
    for r in staged[5].collect():
        assert r.ids == sp.encode(r.text) and r.n_tokens == len(r.ids) and r.decoded == r.text


def test_run_gives_what_the_stages_give(spark, sf, staged):
    key = lambda r: (r.doc_id, r.text, tuple(r.ids))
    assert sorted(map(key, P.run(spark, sf).collect())) == sorted(map(key, staged[5].collect()))


def test_odd_rows_pass_every_stage(spark, tmp_path):
    good = "A sentence that says something new and ends as it should, number {}."
    docs = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, good.format(1), None, None, 3), (3, good.format(2), "en", "a", 9), (3, good.format(2), "en", "a", 9), (4, "\n".join(good.format(k) for k in range(5, 3000)), "en", "b", 1)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint, Parts string")
    for data in (df, df.limit(0)):
        now = data
        for k, (_, stage) in enumerate(P.STAGES):
            stage(spark, now, "").write.mode("overwrite").parquet(f"{tmp_path}/{k}")
            now = spark.read.parquet(f"{tmp_path}/{k}")
        texts = [r.text for r in now.collect()]
        assert all(r.decoded == r.text for r in now.collect())
        assert (data is df) == bool(texts)
