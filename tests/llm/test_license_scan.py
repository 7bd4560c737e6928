import pytest

from tagweave.llm import license_scan as L
from tagweave.llm.license_templates import TEMPLATES


def best_matches(text, template, least):
    """Whether the template's tokens occur as a subsequence of some short stretch: longest common subsequence by brute force."""
    doc, want = L.doc_words(text), L.words(template)
    best = 0
    for start in range(len(doc)):
        part = doc[start : start + len(want) + L.BAND]
        row = [0] * (len(part) + 1)
        for t in want:
            new = [0]
            for j, d in enumerate(part):
                new.append(max(row[j + 1], new[j], row[j] + (t == d)))
            row = new
        best = max(best, row[-1])
    return best >= least * len(want)


NOTICES = sorted(n for n, t in TEMPLATES.items() if len(L.words(t)) <= 200)
WHOLE = sorted(set(TEMPLATES) - set(NOTICES))


@pytest.fixture(scope="module")
def index():
    return L.Index(TEMPLATES, L.K, L.WINDOW)


@pytest.mark.parametrize("name", NOTICES)
def test_each_template_is_found_whole_and_with_a_gap(index, name):
    text = TEMPLATES[name]
    found = {f[0]: f for f in L.scan([f"Some words. {text} And more words."], index)[0]}
    assert found[name][2] == 1.0
    words = text.split()
    if len(words) > 8:
        del words[len(words) // 2]
        damaged = "lead in " * 30 + " ".join(words) + " tail"
        assert name in {f[0] for f in L.scan([damaged], index)[0]}
        assert best_matches(damaged, text, L.MIN_COVERAGE)


def test_spans_are_characters_of_the_text(index):
    text = "İstanbul. Licensed under the Apache License, Version 2.0. End"
    ((name, matched, coverage, a, b),) = L.scan([text], index)[0]
    assert (name, matched, coverage) == ("apache-2.0-line", 8, 1.0)
    assert text[a:b] == "Licensed under the Apache License, Version 2.0"


def test_a_lesser_template_within_another_is_not_reported(index):
    assert [f[0] for f in L.scan(["Licensed under CC BY-NC 4.0."], index)[0]] == ["cc-by-nc-4.0-line"]
    assert [f[0] for f in L.scan(["Licensed under CC BY 4.0."], index)[0]] == ["cc-by-4.0-line"]


def test_two_occurrences_and_clean_text(index):
    two = L.scan(["All rights reserved. x y z All rights reserved."], index)[0]
    assert len(two) == 2
    assert L.scan(["the rights of all were reserved for the software and this is provided"], index) == [[]]


def test_banded_alignment_against_full_dynamic_programming():
    doc, template = [1, 2, 9, 3, 4, 5], [1, 2, 3, 4, 5]
    assert L.align(doc, template, 0, 3) == (5, 0, 6)
    assert L.align(doc, template, 1, 3)[0] == 5


def test_edges(spark):
    cols = "doc_id bigint, text string, license string, Coverage int"
    line = "All rights reserved."
    df = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (None, line, None, None), (3, line, "x", 1), (3, line, "x", 1), (4, "word " * 200_000 + line, "x", 1)], cols)
    out = L.scan_licenses(df).collect()
    assert sorted((r.doc_id or -1) for r in out) == [-1, 3, 3, 4]
    assert {r.span_start for r in out if r.doc_id == 4} == {1_000_000}
    assert L.scan_licenses(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", WHOLE)
def test_whole_licences_with_changes(index, name):
    import random

    rng = random.Random(name)
    words = TEMPLATES[name].split()
    assert (name, len(L.words(TEMPLATES[name]))) in {f[:2] for f in L.scan(["before " * 50 + TEMPLATES[name] + " after"], index)[0]}
    for at in rng.sample(range(len(words)), len(words) // 12):
        words[at] = rng.choice(["zzz", "the", "of"])
    found = {f[0]: f for f in L.scan(["before " * 50 + " ".join(words) + " after"], index)[0]}
    assert 0.85 < found[name][2] < 0.97
    assert name not in {f[0] for f in L.scan([" ".join(words[: len(words) // 2])], index)[0]}


def pairwise(found):
    return [f for f in found if not any(g[1:3] > f[1:3] and g[3] <= f[3] and f[4] <= g[4] for g in found)]


def test_the_sweep_against_all_pairs():
    import random

    rng = random.Random(8)
    for _ in range(400):
        found = []
        for k in range(rng.randint(0, 12)):
            a = rng.randint(0, 12)
            found.append((k, rng.randint(1, 3), rng.choice([0.8, 1.0]), a, a + rng.randint(1, 6)))
        assert L.outermost(found) == pairwise(found)


def test_many_notices_in_a_text(index):
    import time

    start = time.time()
    assert len(L.scan(["All rights reserved. Released under the MIT License. " * 40_000], index)[0]) == 80_000
    assert time.time() - start < 30


def test_a_lesser_notice_goes_whichever_templates_are_beside(index):
    both = L.Index({"long": "one two three four five six seven", "short": "three four five"}, L.K, L.WINDOW)
    assert [f[0] for f in L.scan(["x one two three four five six seven y"], both)[0]] == ["long"]
    other = L.Index({"long": "one two three four five six seven", **TEMPLATES, "short": "three four five"}, L.K, L.WINDOW)
    assert [f[0] for f in L.scan(["x one two three four five six seven y"], other)[0]] == ["long"]


def test_documents_against_the_full_alignment(spark, sf):
    """All notices of up to 20 words, in every document of the table, by whole tables over all spans that could hold them."""
    short = {n: t for n, t in TEMPLATES.items() if len(L.words(t)) <= 20}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.license) for r in L.scan_licenses(docs, short).collect()}
    want = set()
    for r in docs.collect():
        doc = L.doc_words(r.text)
        for name, text in short.items():
            template = L.words(text)
            known, m = set(template), len(template)
            for a, w in enumerate(doc):
                if w in known and len(known & set(doc[a : a + m + m // 4 + 1])) >= L.MIN_COVERAGE * len(known) - 1 and full_alignment_from(doc[a : a + int(m / L.MIN_COVERAGE) + 1], template):
                    want.add((r.doc_id, name))
                    break
    assert got <= want and want
    # one that isn't reported lies within another notice, which shares most of its words
    alike = lambda n, k: n != k and len({*L.words(short[n])} & {*L.words(short[k])}) >= 0.6 * len({*L.words(short[n])})
    assert all(any(i == j and alike(n, k) for j, k in got) for i, n in want - got)


def full_alignment(doc, want):
    """Whether some span of doc matches 0.8 of the template's tokens, and of its own, in order: all spans, whole tables."""
    for a in range(len(doc)):
        row = [0] * (len(want) + 1)
        for b in range(a, len(doc)):
            new = [0]
            for i, t in enumerate(want):
                new.append(row[i] + 1 if t == doc[b] else max(row[i + 1], new[i]))
            row = new
            if row[-1] >= L.MIN_COVERAGE * max(len(want), b + 1 - a):
                return True
    return False


def full_alignment_from(doc, want):
    """The same of the spans that begin at doc[0]."""
    row = [0] * (len(want) + 1)
    for b, w in enumerate(doc):
        new = [0]
        for i, t in enumerate(want):
            new.append(row[i] + 1 if t == w else max(row[i + 1], new[i]))
        row = new
        if row[-1] >= L.MIN_COVERAGE * max(len(want), b + 1):
            return True
    return False


def changed(tokens):
    """Every change, deletion and insertion of one word."""
    for i in range(len(tokens) + 1):
        yield tokens[:i] + ["zzz"] + tokens[i:]
        yield tokens[:i] + ["the"] + tokens[i:]
    for i in range(len(tokens)):
        yield tokens[:i] + tokens[i + 1 :]
        yield tokens[:i] + ["zzz"] + tokens[i + 1 :]


@pytest.mark.parametrize("name", NOTICES)
def test_every_change_of_one_word_against_the_full_alignment(name):
    alone = L.Index({name: TEMPLATES[name]}, L.K, L.WINDOW)
    want = L.words(TEMPLATES[name])
    docs = [["of", "the", "x", *d, "y", "and", "the"] for d in changed(want)]
    docs = docs[:: 1 if len(want) <= 20 else 7]
    found = L.scan([" ".join(d) for d in docs], alone)
    expected = [True] * len(docs) if len(want) > 20 else [full_alignment(d, want) for d in docs]
    assert [bool(f) for f in found] == expected


def test_random_changes_against_the_full_alignment():
    import random

    rng = random.Random(5)
    kept = 0
    for name, text in TEMPLATES.items():
        want = L.words(text)
        if len(want) > 20:
            continue
        alone = L.Index({name: text}, L.K, L.WINDOW)
        docs = []
        for _ in range(150):
            d = list(want) * rng.randint(1, 2)
            for _ in range(rng.randint(1, 6)):
                i = rng.randrange(len(d) + 1)
                d[i : i + rng.randint(0, 1)] = [rng.choice([*want, "zzz"])] * rng.randint(0, 2)
            docs.append(d)
        expected = [full_alignment(d, want) for d in docs]
        kept += sum(expected)
        assert [bool(f) for f in L.scan([" ".join(d) for d in docs], alone)] == expected
    assert kept > 300


def test_notices_that_miss_a_fingerprint_of_three_words(index):
    assert [f[:2] for f in L.scan(["Released under MIT License."], index)[0]] == [("mit-line", 4)]
    assert [f[:2] for f in L.scan(["Licensed under the CC BY 4.0"], index)[0]] == [("cc-by-4.0-line", 6)]
    # two changed copies side by side are two; the dense part of a notice with a word far ahead is one
    assert len(L.scan(["Released under MIT License. Released under MIT License."], index)[0]) == 2
    assert [f[1] for f in L.scan(["Released x under the y MIT License"], index)[0]] == [4]


def test_chunks_of_hits(index, monkeypatch):
    texts = [None, "", *TEMPLATES.values(), "of the " * 50, " ".join(TEMPLATES.values())]
    whole = L.scan(texts, index)
    monkeypatch.setattr(L, "CHUNK", 1)
    assert L.scan(texts, index) == whole


def test_higher_coverage_is_winnowed():
    high = L.Index({"mit": TEMPLATES["mit"]}, L.K, L.WINDOW, 0.95)
    assert len(high.grams[L.K][2]) < len(L.words(TEMPLATES["mit"])) * 2 // 3
    words = TEMPLATES["mit"].split()
    assert all(L.scan([" ".join(words[:i] + ["zzz"] + words[i + 1 :])], high, min_coverage=0.95)[0] for i in range(0, len(words), 7))
    assert L.scan([TEMPLATES["mit"]], L.Index(TEMPLATES, L.K, L.WINDOW, 1.1), min_coverage=1.1) == [[]]
