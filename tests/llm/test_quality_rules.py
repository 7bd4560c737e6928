import time

from pyspark.sql import functions as F

from tagweave.llm import quality_rules as Q

GOOD = "This is a plain sentence about nothing much at all, and it ends well."


def failing(spark, line):
    df = spark.createDataFrame([(line,)], "line string")
    r = df.select(*[v.alias(k) for k, v in Q.failures(F.col("line"), Q.line_words(F.col("line"))).items()]).first()
    return {k for k in Q.RULES if r[k]}


def test_rules(spark):
    assert failing(spark, GOOD) == set()
    assert failing(spark, "A title of few words") == set()
    assert failing(spark, "one two three four five six seven eight nine ten eleven twelve thirteen") == {"punctuation"}
    assert "symbols" in failing(spark, "word*** other&&& more$$$ words### again%%%.")
    assert "shouting" in failing(spark, "WORDS!! LIKE!! THESE!!")
    assert "navigation" in failing(spark, "Home | Products | About | Contact")
    assert failing(spark, "Read more") == {"navigation"}
    assert failing(spark, "All rights reserved.") == {"boilerplate"}
    for line in ("Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados."):
        assert failing(spark, line) == {"boilerplate"}
    for line in ("Startseite", "Lire la suite", " INICIO "):
        assert failing(spark, line) == {"navigation"}
    assert failing(spark, "\tone two three four five six seven eight nine ten eleven") == set()  # a tab makes no word
    assert "repetition" in failing(spark, "the the the the the end end end end.")
    assert failing(spark, 'He set token = "abc" and 1 < 2, which is fine here.') == set()


def test_documents(spark):
    df = spark.createDataFrame([(1, f"{GOOD}\nHome | Products | About\n\n{GOOD}", "x"), (2, f"{GOOD}\n" + "BUY!! NOW!! " * 30, "x"), (3, None, None), (4, "", "x"), (5, " \n\t", "x"), (None, GOOD, None), (6, "The.", "x"), (7, GOOD, "y"), (7, GOOD, "y"), (8, (GOOD + "\n") * 2000, "x")], "doc_id int, text string, LINES_IN string")
    out = Q.clean_lines(df)
    assert out.columns == ["doc_id", "text", "LINES_IN", "_lines_in", "lines_kept"]
    got = {(r.doc_id, r.text[:200]): (r["_lines_in"], r.lines_kept) for r in out.collect()}
    assert got[1, f"{GOOD}\n\n{GOOD}"] == (3, 2)
    assert {k[0] for k in got} == {1, None, 6, 7, 8}
    assert out.where("doc_id = 7").count() == 2
    assert Q.clean_lines(df.limit(0)).collect() == []


def test_no_shuffle_and_one_pass(spark, sf):
    plan = Q.op3(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_long_word_is_judged_in_proportion(spark):
    """Shouting was tried again at each character of a word."""
    df = spark.createDataFrame([(1, "a" * 300_000), (2, "a" * 300_000 + " b!!"), (3, "b!! c!! d!!")], "doc_id int, text string")
    began = time.time()
    assert {r.doc_id for r in Q.clean_lines(df).collect()} == {1, 2}
    assert time.time() - began < 20


def test_plain_search_misses_no_match(spark):
    """Each entry of the long patterns holds what is searched for before the pattern is tried."""
    for lang, items in Q._MENU.items():
        df = spark.createDataFrame([(x,) for x in items.split("|")], "line string")
        assert df.where(~Q.failures(F.col("line"), Q.line_words(F.col("line")))["navigation"]).collect() == [], lang
    for a in ("javascript is disabled", "javascript is required", "terms of use", "terms of service", "javascript ist deaktiviert", "conditions d'utilisation", "conditions générales d'utilisation", "términos de uso", "condiciones de servicio", "términos de servicio", "condiciones de uso"):
        assert "boilerplate" in failing(spark, a.upper()), a
    plain = [x for items in Q._BOILERPLATE.values() for x in items.split("|") if not set(x) & set("()?")]
    df = spark.createDataFrame([(x,) for x in plain], "line string")
    assert df.where(~Q.failures(F.col("line"), Q.line_words(F.col("line")))["boilerplate"]).collect() == []
    assert "shouting" in failing(spark, "!!") and "shouting" in failing(spark, "x\ty!!! z!!\u0085")
    for bar in Q._BARS:
        assert "navigation" in failing(spark, f"Home {bar} Products {bar} About")
