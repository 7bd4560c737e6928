import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tagweave.llm import line_dedup as D


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, min_chars=D.MIN_CHARS):
    """docs: [(doc_id, text)] with distinct ids, in order."""
    seen, out = [], {}
    for i, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            if not line.strip():
                kept.append(line)
                continue
            near = any(line == s or (min(len(line), len(s)) >= min_chars and abs(len(line) - len(s)) < 2 and edits(line, s) < 2) for s in seen)
            if not near:
                kept.append(line)
            seen.append(line)
        out[i] = "\n".join(kept)
    return out


@given(st.text(max_size=30), st.integers(0, 40), st.text(max_size=1))
@settings(max_examples=200, deadline=None)
def test_strings_one_edit_apart_share_a_key(text, at, other):
    at = min(at, len(text))
    for changed in (text[:at] + text[at + 1 :], text[:at] + other + text[at:], text[:at] + other + text[at + 1 :]):
        assert set(D.deletion_keys(text)) & set(D.deletion_keys(changed))


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde fghi") for _ in range(rng.choice([3, 9, 10, 11, 25, 60]))) + "x" for _ in range(40)]

    def vary(s):
        k = rng.randrange(4)
        p = rng.randrange(len(s))
        return s if k == 0 else s[:p] + s[p + 1 :] if k == 1 else s[:p] + "é" + s[p:] if k == 2 else s[:p] + "ß" + s[p + 1 :]

    docs = []
    for i in range(60):
        text = "\n".join(vary(vary(rng.choice(base))) if rng.random() < 0.3 else vary(rng.choice(base)) for _ in range(6))
        docs.append((i, text + rng.choice(["", "\n", "\n  \nend"])))
    got = {r.doc_id: r.text for r in D.dedup_lines(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == brute(docs)


def test_two_edits_against_brute_force(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcde fghi") for _ in range(rng.choice([8, 12, 19, 20, 21, 33]))) + "x" for _ in range(25)]

    def vary(s):
        k = rng.randrange(4)
        p = rng.randrange(len(s))
        return s if k == 0 else s[:p] + s[p + 1 :] if k == 1 else s[:p] + "é" + s[p:] if k == 2 else s[:p] + "ß" + s[p + 1 :]

    docs = [(i, "\n".join(vary(vary(vary(rng.choice(base)))) for _ in range(5))) for i in range(40)]
    want, seen = {}, []
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            if not any(line == s or edits(line, s) <= min(2, min(len(line), len(s)) // D.MIN_CHARS) for s in seen):
                kept.append(line)
            seen.append(line)
        want[i] = "\n".join(kept)
    got = {r.doc_id: r.text for r in D.dedup_lines(spark.createDataFrame(docs, "doc_id int, text string"), max_edits=2).collect()}
    assert got == want
    for line in ("", "a", "ab", "abcdef"):
        assert len(D.deletion_keys(line, 2)) == len({"".join(c for k, c in enumerate(line) if k not in (i, j)) for i in range(-1, len(line)) for j in range(-1, len(line))})


def test_the_filter_keeps_no_key_out(spark):
    keys = spark.range(0, 5000, 7).selectExpr("case when id = 0 then null else id end as w_id")
    rows = spark.range(5000).selectExpr("case when id = 0 then null else id end as doc_id")
    kept = {r.doc_id for r in rows.where(D.maybe_among(keys, "w_id", rows["doc_id"])).collect()}
    want = {r.w_id for r in keys.collect()}
    assert want <= kept and len(kept - want) < 0.15 * 5000
    assert rows.where(D.maybe_among(keys.limit(0), "w_id", rows["doc_id"])).count() == 0


def test_many_lines_in_a_document(spark):
    lines = [f"line {k} of a long document" for k in range(30_000)]
    (r,) = D.dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")).collect()
    assert r.n_lines == 30_000 and r.n_dropped > 25_000  # numbers that differ in a digit are one edit apart


def test_edges(spark):
    df = spark.createDataFrame(
        [(1, "the same line here\n\nother", "a", 0), (2, "the same lime here", "a", 0), (3, None, "a", 0), (4, "", "b", 0), (None, "the same line here", "b", 0), (5, "x\nx", "b", 0), (5, "x\nx", "b", 0), (6, "long " * 20_000 + "\nlong", "b", 0)],
        "doc_id bigint, text string, K string, N_Lines int",
    )
    out = D.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "K", "N_Lines", "_n_lines", "n_dropped"]
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append((r.text, r["_n_lines"], r.n_dropped))
    assert by[1] == [("the same line here\n\nother", 2, 0)]
    assert by[2] == [("", 1, 1)] and by[3] == [(None, 0, 0)] and by[4] == [("", 0, 0)]
    assert by[None] == [("", 1, 1)]
    assert by[5] == [("x", 2, 1)] * 2  # a repeated row is the same document
    assert by[6][0][1:] == (2, 0)
    assert D.dedup_lines(df.limit(0)).collect() == []
    exact = {r.doc_id: r.text for r in D.dedup_lines(df, max_edits=0).collect()}
    assert exact[2] == "the same lime here"
