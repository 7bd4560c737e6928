import fnmatch
import random
import re

from pyspark.sql import functions as F

from tagweave.llm import url_filters as U


def test_automaton_against_regular_expressions():
    rng = random.Random(2)
    globs = ["*", "", "?", "a*b", "*ab", "ab*", "*a*b*", "a??b", "a*?b", "**a", "abc", "*?", "??", "*é?*"] + ["".join(rng.choice("ab*?cé") for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    urls = ["", "a", "ab", "abc", "aab"] + ["".join(rng.choice("abcé漢") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    want = [[k for k, g in enumerate(globs) if re.fullmatch(fnmatch.translate(g), u)] for u in urls]
    auto = U.Automaton(globs)
    assert auto.words > 1
    assert auto.matches([u.encode() for u in urls]) == want
    assert auto.matches([]) == []


def test_canonical(spark):
    cases = {" HTTP://User:pw@WWW.Example.COM:80/A?b=C#frag ": "http://example.com/A?b=C", "https://x.org:443": "https://x.org/", "x.org/p": "http://x.org/p", "http://x.org?q=1": "http://x.org/?q=1", "": "http:///", "http://x.org:8080/": "http://x.org:8080/"}
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.c for r in df.select("url", U.canonical(F.col("url")).alias("c")).collect()} == cases


def test_ways_round_a_rule_are_one_canonical_url(spark):
    cases = {
        "//x.org/login": "http://x.org/login", "http://x.org/a/../login": "http://x.org/login", "http://x.org/%6Cogin": "http://x.org/login", "http://x.org./login": "http://x.org/login", "x.org.:8080/p": "http://x.org:8080/p",
        "http://x.org/./a/./b/.": "http://x.org/a/b/", "http://x.org/../../login": "http://x.org/login", "http://x.org/a/b/..": "http://x.org/a/", "http://x.org/..": "http://x.org/", "http://x.org/a%2fb%zz%4": "http://x.org/a%2Fb%zz%4",
        "http://x.org/%2e%2E/login?q=%41/../b": "http://x.org/login?q=A/../b", "http://x.org//a/...": "http://x.org//a/...", "//user@WWW.x.org": "http://x.org/", "http://x.org/%C3%a9": "http://x.org/%C3%A9",
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.c for r in df.select("url", U.canonical(F.col("url")).alias("c")).collect()} == cases
    import duckdb

    con = duckdb.connect()
    con.execute("create table pages (page_id int, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(cases)))
    assert [r[0] for r in con.sql(f"select canonical_url from ({U.OP6_SQL}) order by page_id").fetchall()] == list(cases.values())
    blocked = U.filter_urls(df).where("url like '%ogin%'").collect()
    assert blocked and all(r.blocked for r in blocked if "?" not in r.url)


def test_edges(spark):
    rules = [U.Rule(1, "block", "x", "*/login*"), U.Rule(2, "allow", "x", "*good*"), U.Rule(7, "block", "x", "*bad*")]
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x.org/login", "a"), (3, "x.org/login", "a"), (4, "good.org/login/bad", None), (5, "x.org/" + "a" * 100_000 + "bad", "a"), (None, "x.org", "a")], "page_id int, url string, Rules string")
    out = U.filter_urls(df, rules)
    assert out.columns == ["page_id", "url", "Rules", "canonical_url", "_rules", "blocked"]
    got = [(r.page_id, r["_rules"], r.blocked) for r in out.collect()]
    assert got == [(1, None, False), (2, [], False), (3, [1], True), (3, [1], True), (4, [1, 2, 7], False), (5, [7], True), (None, [], False)]
    assert U.filter_urls(df.limit(0), rules).collect() == []
