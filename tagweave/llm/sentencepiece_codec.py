"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Texts are cut into marked words (``▁`` before each, as no piece crosses such a mark). The distinct words of a
batch are sorted, which makes them a trie in depth-first order: each word keeps the forward states of the
prefix that it shares with the word before and goes on from there.

The forward state depends on the kind of model. For a unigram model it is the best score of the prefix and the
last piece on that path. For a BPE model scores are merge ranks, whose sum says nothing about what merging
gives, so the state is the last piece of the prefix's merged segmentation: it is the one piece that may follow
the last piece of what is before it, two pieces being compatible if merging their text gives just these two.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import fresh

MODEL_FILE = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
WORDS_KEPT = 200_000
PAIRS_KEPT = 250_000
UNKNOWN_PENALTY = 10.0


class Codec:
    """Vocabulary of one model file and the forward pass over it."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(model_file, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser and ▁ before words are supported")
        kind = pb.ModelProto.SentencePiece
        self.bpe = m.trainer_spec.model_type == pb.TrainerSpec.BPE
        if not self.bpe and m.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM:
            raise ValueError("only BPE and unigram models are supported")
        self.prefix = MARK if n.add_dummy_prefix else ""
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == kind.UNKNOWN)
        self.vocab = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        self.byte = {int(p.piece[3:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kind.BYTE}
        self.score = [p.score for p in m.pieces]
        if any(MARK in p.lstrip(MARK) for p in self.vocab):
            raise ValueError("a piece crosses the start of a word")
        # characters of no piece longer than themselves: nothing merges across them, so words end there
        inner = set("".join(p for p in self.vocab if len(p) > 1))
        stop = "" if "\n" in inner else "\n"
        self.pattern = re.compile(rf"{MARK}*[^{MARK}{stop}]+|{MARK}+" + (f"|{stop}" if stop else ""))
        # pieces by their last characters: a trie of dicts, read backwards, with the piece's id under ""
        self.endings: dict = {}
        for p, i in self.vocab.items():
            node = self.endings
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        self.least = min((self.score[i] for i in self.vocab.values()), default=0.0)
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.spines: dict[str, tuple[list, list]] = {}
        self.text = {i: p for p, i in self.vocab.items()}
        self.known: dict[str, bytes] = {}
        # for decoding: the bytes of each id
        special = {kind.CONTROL: b"", kind.UNKNOWN: " ⁇ ".encode()}
        raw = [bytes([int(p.piece[3:-1], 16)]) if p.type == kind.BYTE else special[p.type] if p.type in special else p.piece.replace(MARK, " ").encode() for p in m.pieces]
        self.flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    # -- forward pass

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """Pieces of a short text by merging the best-ranked pair, leftmost first, until none or ``down_to`` are left."""
        parts = list(text)
        while True:
            if len(parts) <= down_to:
                return parts
            best = None
            for i in range(len(parts) - 1):
                t = self.vocab.get(parts[i] + parts[i + 1])
                if t is not None and (best is None or self.score[t] > best[0]):
                    best = (self.score[t], i)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def spine(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """What a piece's merging leaves at its left and at its right end, last state first, with the rank that made it."""
        got = self.spines.get(piece)
        if got is None:
            if len(piece) == 1:
                got = [(piece, -1.0)], [(piece, -1.0)]
            else:
                rank = -self.score[self.vocab[piece]]
                left, right = self.merged(piece, down_to=2)
                got = [(piece, rank), *self.spine(left)[0]], [(piece, rank), *self.spine(right)[1]]
            self.spines[piece] = got
        return got

    def follows(self, u: int, t: int) -> bool:
        """Whether u and t, side by side, come out of merging as they are: no merge across them comes first."""
        key = u << 32 | t
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            ok = self.pairs[key] = self.stands(t) and self.stands(u) and self._apart(self.spine(self.text[u])[1], self.spine(self.text[t])[0])
        return ok

    def _apart(self, rights: list[tuple[str, float]], lefts: list[tuple[str, float]]) -> bool:
        vocab, score = self.vocab, self.score
        i = j = 0
        limit = float("inf")
        while True:
            (a, made_a), (b, made_b) = rights[i], lefts[j]
            across = vocab.get(a + b)
            if across is not None and -score[across] < limit:
                return False
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:  # undo what was merged last
                limit, i = made_a, i + 1
            else:  # of equal pairs the left one merges first, so the same rank across wins
                limit, j = made_b + 0.5, j + 1

    def stands(self, t: int) -> bool:
        ok = self.alone.get(t)
        if ok is None:
            ok = self.alone[t] = self.merged(self.text[t]) == [self.text[t]]
        return ok

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(word, its ids as int32 bytes) for distinct words, in sorted order."""
        endings, score, pairs = self.endings, self.score, self.pairs
        last: list[int] = []  # for each prefix the id of its last piece, -1 for a character without one
        length: list[int] = []
        best: list[float] = [0.0]
        before = ""
        for word in sorted(words):
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same:], length[same:], best[same + 1 :]
            for i in range(same, len(word)):
                end = i + 1
                ends: list[tuple[int, int]] = []  # (length, id) of the pieces that end here, the shortest first
                node, k = endings, i
                while k >= 0:
                    node = node.get(word[k])
                    if node is None:
                        break
                    t = node.get("")
                    if t is not None:
                        ends.append((end - k, t))
                    k -= 1
                got, size = -1, 1
                if self.bpe:
                    for k, t in reversed(ends):
                        u = last[i - k] if k < end else -1
                        # nothing merges with a character that is no piece
                        ok = self.stands(t) if u < 0 else pairs.get(u << 32 | t)
                        if self.follows(u, t) if ok is None else ok:
                            got, size = t, k
                            break
                else:
                    top = best[i] + self.least - UNKNOWN_PENALTY
                    for k, t in ends:
                        if best[end - k] + score[t] > top or k == 1:
                            top, got, size = best[end - k] + score[t], t, k
                    best.append(top)
                last.append(got)
                length.append(size)
            ids: list[int] = []
            end = len(word)
            while end:
                t = last[end - 1]
                if t >= 0:
                    ids.append(t)
                elif self.byte:
                    ids.extend(self.byte[b] for b in reversed(word[end - 1].encode()))
                else:
                    ids.append(self.unk)
                end -= length[end - 1]
            ids.reverse()
            yield word, array("i", ids).tobytes()
            before = word

    # -- batches

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """int32 bytes of the ids of each text; an empty text has none."""
        split = [None if t is None else self.pattern.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        new = {w for ws in split if ws for w in ws if w not in known}
        if len(known) + len(new) <= WORDS_KEPT:
            known.update(self.encode_words(new))
            look = known.__getitem__
        else:
            more = dict(self.encode_words(new))
            get = known.get
            look = lambda w: get(w) or more[w]
        return [None if ws is None else b"".join(map(look, ws)) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes that aren't UTF-8 become U+FFFD; the prefix that encoding put before is taken away."""
        if not len(ids):
            return ""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        text = self.flat[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def _pieces(b: pa.RecordBatch, text: int, chars: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text, at least a row each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < b.num_rows:
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:], dtype=np.int64), chars, side="right")))
        yield b.slice(at, end - at)
        at = end


def _encode(model_file: str, text: int, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        c = codec(model_file)
        for whole in batches:
            for b in _pieces(whole, text):
                found = c.encode(b.column(text).to_pylist())
                none = np.array([f is None for f in found], dtype=bool)
                counts = np.array([0 if f is None else len(f) // 4 for f in found], dtype=np.int64)
                values = pa.Array.from_buffers(pa.int32(), int(counts.sum()), [None, pa.py_buffer(b"".join(f for f in found if f))])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(none, False))
                new = [pa.ListArray.from_arrays(offsets, values), pa.array(counts.astype(np.int32), mask=none)]
                if decoded:
                    new.append(pa.array([None if f is None else c.decode(np.frombuffer(f, dtype=np.int32)) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[str(k) for k in range(b.num_columns + len(new))])

    return run


def encode(docs: DataFrame, model_file: str = MODEL_FILE, text_col: str = "text", with_decoded: bool = True, drop_text: bool = False) -> DataFrame:
    """``docs`` with the columns ids and n_tokens and, unless ``with_decoded`` is off, decoded: ids decoded again.

    A null text has null ids, n_tokens and decoded; an empty one no ids, 0 and an empty text. Whole texts are
    encoded, whatever their length. decoded equals the text but for ``▁`` in it, which comes back as a space.
    Repeated rows are encoded alike; an empty table gives an empty one; new columns that clash with those of
    ``docs`` get a ``_`` before their names. ``model_file`` must be readable on every worker.
    """
    names = fresh(docs, "ids", "n_tokens", "decoded")[: 3 if with_decoded else 2]
    kinds = [ArrayType(IntegerType()), IntegerType(), StringType()]
    schema = StructType([*docs.schema.fields, *[StructField(n, k) for n, k in zip(names, kinds)]])
    text = [c.lower() for c in docs.columns].index(text_col.lower())
    # under names of their own, as names may clash
    plain = StructType([StructField(str(k), f.dataType) for k, f in enumerate(schema.fields)])
    out = docs.toDF(*[str(k) for k in range(len(docs.columns))]).mapInArrow(_encode(model_file, text, with_decoded), plain).toDF(*schema.names)
    return out.drop(text_col) if drop_text else out


def _decode(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for b in batches:
            texts = [None if x is None else c.decode(np.array([i for i in x if i is not None], dtype=np.int64)) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], str(b.num_columns - 1)])

    return run


def decode(rows: DataFrame, model_file: str = MODEL_FILE, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids_col`` as one column more; null ids give a null text, nulls among ids are skipped."""
    (name,) = fresh(rows, to)
    at = [c.lower() for c in rows.columns].index(ids_col.lower())
    plain = StructType([*[StructField(str(k), f.dataType) for k, f in enumerate(rows.schema.fields)], StructField(str(len(rows.columns)), StringType())])
    numbered = rows.toDF(*[str(k) for k in range(len(rows.columns))])
    return numbered.select("*", numbered[str(at)].alias(str(len(rows.columns)))).mapInArrow(_decode(model_file), plain).toDF(*rows.columns, name)


def op5(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, ids, n_tokens, decoded."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), drop_text=True)
