"""Licence scan: winnowed fingerprints of templates pick candidates, banded alignment decides.

The templates' token k-grams are hashed and winnowed (the least hash of every window stays); the fingerprints
form an inverted index hash -> (template, position). Every k-gram of a document is looked up. Hits of a template
on nearby diagonals are one candidate, which a banded local alignment of the two token sequences settles: matched
tokens, coverage of the template, and span in the document. Only the index travels; nothing is shuffled.

k and the window are a template's own: no larger than the run of tokens in order that the least allowed coverage
can't break, so that every occurrence has a hit. At a coverage of 0.8 that run is of 2 tokens for most lengths
(changes, gaps and extra tokens may come every 2 tokens), and winnowing leaves every 2- or 3-gram; at 0.95 it is of
9 tokens for 163, and 3-grams are winnowed by windows of 4. Diagonals with fewer hits nearby than
an occurrence has at least are dropped before the alignment, which loses nothing either.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import WORD, batch_of, mix64, pick, words
from .license_templates import TEMPLATES

K = 3
WINDOW = 4
BAND = 8
MIN_COVERAGE = 0.8
#: Hits are expanded for so many (position, template) pairs at once, or for one document.
CHUNK = 2_000_000
NEED = 1 << 32  # more than any template's tokens
#: Templates of so many tokens get shorter k-grams, if an occurrence has many hits only so.
LONG = 64
#: Of templates that take so many hits, diagonals are aligned the best supported first, and not where they add no hit.
MANY = 32

FINDING = "doc_id bigint, license string, matched_tokens int, coverage double, span_start int, span_end int"


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k token hashes; of what there is if there are fewer."""
    n = max(1, len(ids) - k + 1) if len(ids) else 0
    h = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(ids))):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n])
    return h


def winnow(h: np.ndarray, window: int) -> list[int]:
    """Positions of the least hash (the rightmost of equals) of every window; of all if there are fewer."""
    out: list[int] = []
    for s in range(max(1, len(h) - window + 1)) if len(h) else ():
        w = h[s : s + window]
        p = s + len(w) - 1 - int(np.argmin(w[::-1]))
        if not out or out[-1] != p:
            out.append(p)
    return out


def align(doc: list[int], template: list[int], centre: int, band: int) -> tuple[int, int, int]:
    """(matched tokens, first, last + 1 in doc) of the best alignment of the whole template within the band.

    Tokens of the document before and after are free. A token of the template that is missing, or replaced, isn't
    matched; of equally good alignments the one of the shortest span counts.
    """
    m = len(template)
    exact = doc[centre : centre + m] if centre >= 0 else []
    if exact == template:
        return m, centre, centre + m
    # best[d]: (matched, -start) of aligning template[:i] ending before doc position i + centre + d - band
    width = 2 * band + 1
    none = (0, None)
    row = [none] * width
    for i, t in enumerate(template):
        new = [none] * width
        for d in range(width):
            j = i + centre + d - band  # doc token against template token i
            best, start = row[d]
            if 0 <= j < len(doc) and doc[j] == t:
                cand = (best + 1, j if start is None else start)
            else:
                cand = (best, start)
            if d + 1 < width and _better(row[d + 1], cand):  # template token i is missing
                cand = row[d + 1]
            if d and _better(new[d - 1], cand):  # an extra token in the document
                cand = new[d - 1]
            new[d] = cand
        row = new
    matched, start = row[0]
    where = 0
    for d in range(1, width):
        if _better(row[d], (matched, start)):
            matched, start, where = *row[d], d
    if not matched:
        return 0, 0, 0
    end = min(len(doc), m + centre + where - band)
    last = set(template)
    while end > start and doc[end - 1] not in last:
        end -= 1
    return matched, start, end


def _better(a: tuple, b: tuple) -> bool:
    return a[0] > b[0] or a[0] == b[0] and a[0] > 0 and a[1] > b[1]


def occurrences(m: int, min_coverage: float) -> list[tuple[int, int, int]]:
    """(matched, tokens missing, most extra tokens) of the occurrences that a template of m tokens may have."""
    least = max(min_coverage, 1 / m)
    return [(n, m - n, int(n / least + 1e-9) - n) for n in range(1, m + 1) if n >= min_coverage * m]


def trim(doc: list[int], template: list[int], lo: int, hi: int, min_coverage: float) -> tuple[int, int, int]:
    """Like align, of the spans in doc[lo:hi] of which min_coverage is matched: by the longest common subsequence of each."""
    m = len(template)
    bits: dict[int, int] = {}
    for i, t in enumerate(template):
        bits[t] = bits.get(t, 0) | 1 << i
    full = (1 << m) - 1
    best = (0, 0, 0)
    lo, hi = max(0, lo), min(len(doc), hi)
    most = int(m / max(min_coverage, 1 / m) + 1e-9)
    for a in range(lo, hi):
        if doc[a] not in bits:
            continue
        v, matched = full, 0
        for b in range(a, min(hi, a + most)):
            x = v & bits.get(doc[b], 0)
            if not x:
                continue
            v = (v + x | v - x) & full
            n = m - v.bit_count()
            if n > matched:
                matched = n
                if n >= min_coverage * max(m, b + 1 - a) and (n, a - b) > (best[0], best[1] - best[2] + 1):
                    best = (n, a, b + 1)
    return best


class Index:
    """Inverted index of the winnowed fingerprints of templates, for occurrences of min_coverage at least."""

    def __init__(self, templates: Mapping[str, str], k: int, window: int, min_coverage: float = MIN_COVERAGE) -> None:
        self.names = list(templates)
        self.vocab: dict[str, int] = {}
        self.tokens = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(t)] for t in templates.values()]
        self.hash = np.concatenate([np.zeros(1, np.uint64), np.array([xxhash.xxh3_64_intdigest(w) for w in self.vocab], dtype=np.uint64)])
        self.reach = np.zeros(len(self.names), dtype=np.int64)  # diagonals an occurrence strays from that of any of its hits
        self.need = np.ones(len(self.names), dtype=np.int64)  # hits that an occurrence has at least
        grams: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, ids in enumerate(self.tokens):
            if not ids:
                continue
            allowed = occurrences(len(ids), min_coverage)
            if not allowed:
                continue
            run = min(-(-n // (missing + extra + 1)) for n, missing, extra in allowed)
            for size, keep in ((i, j) for i in range(min(k, run), 0, -1) for j in range(min(window, run - i + 1), 0, -1)):
                # a run of r tokens has (r - size + 1) // keep fingerprints at least
                need = min(-(-(n - (size + keep - 2) * (missing + extra + 1)) // keep) for n, missing, extra in allowed)
                if len(ids) < LONG or need * 8 >= len(ids):
                    break
            self.reach[t] = max(max(missing, extra) for _, missing, extra in allowed)
            self.need[t] = max(1, need)
            into = grams.setdefault(size, {})
            h = gram_hashes(self.hash[ids], size)
            for p in winnow(h, keep):
                into.setdefault(int(h[p]), []).append((t, p))
        #: By size: sorted hashes, where the postings of each begin, the postings' hash numbers and needs as one sorted
        #: number, and their templates and positions.
        self.grams = {}
        for size, g in grams.items():
            known = sorted(g)
            posted = np.array([x for h in known for x in sorted(g[h], key=lambda x: self.need[x[0]])], dtype=np.int64)
            begin = np.cumsum([0, *(len(g[h]) for h in known)])
            needs = np.repeat(np.arange(len(known)), np.diff(begin)) * NEED + self.need[posted[:, 0]]
            self.grams[size] = (np.array(known, dtype=np.uint64), begin, needs, posted[:, 0], posted[:, 1])


def scan_text(text: str, tokens: list[int], hits: list[tuple[int, int, int]], index: Index, band: int, min_coverage: float) -> list[tuple]:
    """Findings of one document. hits: (template, diagonal, position in the document)."""
    by: dict[int, dict[int, list[int]]] = {}
    for t, c, at in hits:
        by.setdefault(t, {}).setdefault(c, []).append(at)
    spans = None
    out = []
    for t, diagonals in by.items():
        template = index.tokens[t]
        m, reach = len(template), min(band, int(index.reach[t]))
        found = set()
        whole = -1  # the end of the last whole occurrence
        inside: set[int] = set()
        for c in sorted(c for c in diagonals if c >= 0 and tokens[c : c + m] == template):
            if c >= whole:
                whole = c + m
                found.add((m, c, whole))
                inside.update(range(c, whole))
        many = index.need[t] >= MANY
        for c, at in sorted(diagonals.items(), key=lambda x: -len(x[1])) if many else diagonals.items():
            if inside.issuperset(at):  # what overlaps a whole occurrence isn't reported
                continue
            f = align(tokens, template, c, reach)
            if many and f[0] >= min_coverage * max(m, f[2] - f[1]):
                inside.update(range(f[1], f[2]))
            if min_coverage * m <= f[0] < min_coverage * (f[2] - f[1]):  # less of it may be dense enough
                f = trim(tokens, template, c - reach, c + m + reach, min_coverage)
            found.add(f)
        taken: list[tuple[int, int]] = []  # sorted; they don't overlap
        for matched, a, b in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])):
            if not matched or matched < min_coverage * max(m, b - a):
                continue
            at = bisect_left(taken, (a, b))
            if at < len(taken) and taken[at][0] < b or at and taken[at - 1][1] > a:
                continue
            taken.insert(at, (a, b))
            if spans is None:
                spans = [m.span() for m in WORD.finditer(text)]
            out.append((index.names[t], matched, matched / m, a, b))
    return [(n, m, c, spans[a][0], spans[b - 1][1]) for n, m, c, a, b in outermost(out)]


def outermost(found: list[tuple]) -> list[tuple]:
    """Of (name, matched, coverage, a, b) those that lie in none that matches more tokens, or as many and more of its template.

    One sweep from the surest on: ``ends`` has, sorted by start, the spans of surer findings that lie in no other of
    them, so their ends are sorted too, and the last that starts at or before ``a`` is the one that reaches furthest.
    """
    starts: list[int] = []
    ends: list[int] = []
    inside: set[int] = set()
    order = sorted(range(len(found)), key=lambda k: found[k][1:3], reverse=True)
    for _, alike in groupby(order, key=lambda k: found[k][1:3]):
        alike = list(alike)
        for k in alike:
            at = bisect_right(starts, found[k][3]) - 1
            if at >= 0 and ends[at] >= found[k][4]:
                inside.add(k)
        for k in alike:  # equally sure ones don't hide each other
            a, b = found[k][3:]
            at = bisect_right(starts, a) - 1
            if at >= 0 and ends[at] >= b:
                continue
            first = bisect_left(starts, a)
            last = first
            while last < len(ends) and ends[last] <= b:
                last += 1
            starts[first:last], ends[first:last] = [a], [b]
    return [f for k, f in enumerate(found) if k not in inside]


def doc_words(text: str) -> list[str]:
    """Words in lower case, as many as the text has as it is written (for positions)."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def scan(texts: list[str | None], index: Index, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> list[list[tuple]]:
    """Findings (license, matched, coverage, start, end) of each text."""
    get = index.vocab.get
    tokens = [[get(w, 0) for w in doc_words(t)] if t else [] for t in texts]
    sizes = np.array([len(t) for t in tokens])
    flat = np.zeros(int(sizes.sum()) + len(tokens), dtype=np.int64)  # a 0 after each text
    starts = np.cumsum(sizes + 1) - sizes - 1
    for s, t in zip(starts, tokens):
        flat[s : s + len(t)] = t
    hits: dict[int, list[tuple[int, int, int]]] = {}
    before = max(map(len, index.tokens), default=0) + band  # diagonals are from -before to the longest text + band
    far = int(sizes.max(initial=0)) + 2 * before + 1
    for size, (known, begin, needs, template, place) in index.grams.items():
        if len(flat) < size:
            continue
        at = np.flatnonzero(flat[: len(flat) - size + 1])
        for j in range(1, size):
            at = at[flat[at + j] > 0]
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(size):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + index.hash[flat[at + j]])
        g = np.minimum(np.searchsorted(known, h), len(known) - 1)
        ok = known[g] == h
        at, g = at[ok], g[ok]
        doc = np.searchsorted(starts, at, side="right") - 1
        # templates that need more hits than the document has of this size can't be in it: their postings are the last
        amount = np.searchsorted(needs, g * NEED + np.bincount(doc, minlength=len(tokens))[doc], side="right") - begin[g]
        at, g, doc, amount = (x[amount > 0] for x in (at, g, doc, amount))
        ends = np.cumsum(amount)
        s = 0
        while s < len(at):
            done = ends[s - 1] if s else 0
            e = max(int(np.searchsorted(ends, done + CHUNK, side="right")), int(np.searchsorted(doc, doc[s], side="right")))
            if e < len(at):  # whole documents
                e = int(np.searchsorted(doc, doc[e], side="left"))
            n = amount[s:e]
            of = np.repeat(np.arange(s, e), n)
            posting = begin[g[of]] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            t, d = template[posting], doc[of]
            position = at[of] - starts[d]
            diagonal = position - place[posting]
            key = (t * len(texts) + d) * far + diagonal + before
            order = np.argsort(key)
            key, t = key[order], t[order]
            reach = np.minimum(index.reach[t], band)
            near = np.searchsorted(key, key + reach, side="right") - np.searchsorted(key, key - reach, side="left")
            keep = near >= index.need[t]
            for x, i in zip(t[keep].tolist(), order[keep].tolist()):
                hits.setdefault(int(d[i]), []).append((x, int(diagonal[i]), int(position[i])))
            s = e
    return [scan_text(texts[d], tokens[d], hits[d], index, band, min_coverage) if d in hits else [] for d in range(len(texts))]


def _run(index: Index, band: int, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(i, *f) for i, found in zip(ids, scan(b.column(1).to_pylist(), index, band, min_coverage)) for f in found]
            col = lambda k: [r[k] for r in rows]
            yield batch_of({"doc_id": (col(0), pa.int64()), "license": (col(1), pa.string()), "matched_tokens": (col(2), pa.int32()), "coverage": (col(3), pa.float64()), "span_start": (col(4), pa.int32()), "span_end": (col(5), pa.int32())})

    return run


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, k: int = K, window: int = WINDOW, band: int = BAND, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per occurrence: doc_id, license, matched_tokens, coverage, span_start, span_end (characters).

    Tokens are runs of word characters, without case. An occurrence is an alignment, within ``band`` tokens of the
    diagonal of a shared fingerprint, that matches at least ``min_coverage`` of the template's tokens, and of those
    of the span, in order; each such alignment has a fingerprint. Occurrences of one template don't overlap: the one
    that matches more stays, of equals the shorter, then the earlier. One that lies within an occurrence of another
    template that matches more tokens, or as many and more of its template, isn't reported; of two that match
    alike both are.

    Null, empty and wordless texts have none. A null doc_id is returned as null; repeated rows are reported once
    each; other columns are ignored, whatever their names; an empty table gives an empty one. Texts are scanned
    whole, however long. Templates are the caller's constants, not data: their index travels with the plan, about
    100 bytes for each of their tokens.
    """
    own = pick(docs, doc_id=id_col, text=text_col)
    own = own.withColumn("doc_id", own["doc_id"].cast("bigint"))
    return own.mapInArrow(_run(Index(templates, k, window, min_coverage), band, min_coverage), FINDING)


def op1(spark, sf_dir: str) -> DataFrame:
    """Licence notices in ``documents``."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
