import random

import numpy as np
import pytest
import sentencepiece

from tagweave.llm import sentencepiece_codec as C

ODD = ["", " ", "  a", "x  y   z ", "a\n\nb", "\t\n", "éçñ ü ß 漢字　z", "ﬁ ①", "<s> hi </s>", "x▁y", "aaaaaaaaaaaa", "    def f(x):\n        return 1", "\x00", "🎉🎉 ok", " \n "]


@pytest.fixture(scope="module")
def pair():
    return C.Codec(C.MODEL_FILE), sentencepiece.SentencePieceProcessor(model_file=C.MODEL_FILE)


def ids(codec, texts):
    return [np.frombuffer(b, dtype=np.int32).tolist() for b in codec.encode(texts)]


def test_ids_are_the_library_s(pair):
    codec, sp = pair
    rng = random.Random(1)
    vocab = list(codec.vocab)[:4000]
    texts = ODD + ["".join(rng.choice(vocab).replace("▁", " ") for _ in range(40)) for _ in range(300)] + ["".join(rng.choice("abcdeinrst ▁\n") for _ in range(80)) for _ in range(300)]
    assert ids(codec, texts) == sp.encode(texts)


def test_documents(pair, spark, sf):
    codec, sp = pair
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert ids(codec, texts) == sp.encode(texts)
    back = [codec.decode(np.array(i)) for i in ids(codec, texts)]
    assert back == texts and back == [sp.decode(i) for i in sp.encode(texts)]


def test_shared_prefixes_and_caches_do_not_change_results(pair, monkeypatch):
    _, sp = pair
    monkeypatch.setattr(C, "WORDS_KEPT", 3)
    monkeypatch.setattr(C, "PAIRS_KEPT", 5)
    codec = C.Codec(C.MODEL_FILE)
    texts = ["inter internal international internationally in i", "nation nations national"] * 2
    assert ids(codec, texts) == sp.encode(texts)


def test_unigram_models(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    kind = pb.ModelProto.SentencePiece
    for piece, score, t in [("<unk>", 0, kind.UNKNOWN), ("▁", -3, kind.NORMAL), ("a", -2, kind.NORMAL), ("b", -2.5, kind.NORMAL), ("ab", -3.1, kind.NORMAL), ("▁a", -2.2, kind.NORMAL), ("ba", -3.3, kind.NORMAL), ("▁ab", -4.9, kind.NORMAL)]:
        m.pieces.add(piece=piece, score=score, type=t)
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces = "identity", False
    path = tmp_path / "u.model"
    path.write_bytes(m.SerializeToString())
    codec, sp = C.Codec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["abab", "ab ba aab", "bbb aba", "aaaabbbb abba"]
    assert ids(codec, texts) == sp.encode(texts)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "hi there", None), (3, "hi there", "c"), (3, "hi there", "c"), (4, "word\n" * 100_000, "d")], "doc_id int, text string, IDS string")
    out = C.encode(df)
    assert out.columns == ["doc_id", "text", "IDS", "_ids", "n_tokens", "decoded"]
    rows = out.collect()
    assert all(r.decoded == r.text for r in rows)
    assert [(r["_ids"], r.n_tokens) for r in rows[:2]] == [(None, None), ([], 0)]
    again = C.decode(out, ids_col="_ids").collect()
    assert all(r["_decoded"] == r.text for r in again)
    assert C.encode(df.limit(0)).collect() == []
    assert C.decode(spark.createDataFrame([([None, 12014],), (None,)], "ids array<int>")).collect()[1].decoded is None
