"""Line-first quality rules.

Every line is judged by itself (punctuation, symbols, shouting, navigation, boilerplate); failing lines are
removed; a document that thereby loses too much of its text is rejected. All of it is one projection of
built-in functions and one filter: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh

MIN_KEPT = 0.5
#: A line of so many words or more needs a mark of a sentence's end, at its own end or within it, as wrapped lines
#: break off within a sentence; short lines may be titles.
LONG_LINE_WORDS = 12
MAX_REPEAT_RATIO = 0.3
MAX_SYMBOL_RATIO = 0.1
MAX_SHOUT_RATIO = 0.5

# The patterns mean the same in Java's and RE2's syntax.
END_MARK = r"""([.!?…]["'”’»)\]]*(\s|$)|[。！？]|[:;]\s*$)"""
SYMBOLS = r"[*&%$#@^~|<>{}\[\]\\=_+•»«]"
NAVIGATION = r"(^|\S\s+)[|»›•>]\s+\S[^|»›•>]*\s[|»›•>](\s|$)"
_MENU = {
    "en": "home|menu|next|previous|login|log in|sign in|sign up|register|search|contact us|about us|read more|share|back to top|skip to content",
    "de": "startseite|menü|weiter|zurück|anmelden|einloggen|registrieren|suche|kontakt|impressum|über uns|mehr lesen|weiterlesen|teilen|nach oben|zum inhalt springen",
    "fr": "accueil|menu|suivant|précédent|connexion|se connecter|s'inscrire|rechercher|contactez-nous|à propos|lire la suite|partager|haut de page|aller au contenu",
    "es": "inicio|menú|siguiente|anterior|iniciar sesión|registrarse|buscar|contacto|sobre nosotros|leer más|compartir|volver arriba|ir al contenido",
}
MENU = rf"^\s*({'|'.join(_MENU.values())})\s*$"
_BOILERPLATE = {
    "en": "all rights reserved|cookie policy|accept cookies|enable javascript|javascript is (disabled|required)|terms of (use|service)|privacy policy|lorem ipsum|subscribe to our newsletter",
    "de": "alle rechte vorbehalten|cookie-richtlinie|cookies akzeptieren|javascript (aktivieren|ist deaktiviert)|nutzungsbedingungen|datenschutzerklärung|newsletter abonnieren",
    "fr": "tous droits réservés|politique de cookies|accepter les cookies|activer javascript|conditions (générales )?d'utilisation|politique de confidentialité|abonnez-vous à notre newsletter",
    "es": "todos los derechos reservados|política de cookies|aceptar cookies|habilitar javascript|(términos|condiciones) de (uso|servicio)|política de privacidad|suscríbete a nuestro boletín",
}
BOILERPLATE = f"({'|'.join(_BOILERPLATE.values())})"
SHOUTED = r"\S*!!+(\s|$)"
#: The same, tried at a word's start only: every match begins there, and a long word isn't tried at each character.
_SHOUTED = rf"(?<!\S){SHOUTED}"
#: What every match of the long patterns holds, found by plain search: the patterns are only tried where it is.
_BARS = "|»›•>"
_MENU_WORDS = max(len(x.split()) for items in _MENU.values() for x in items.split("|"))
_OF_BOILERPLATE = (
    "cookie|javascript|newsletter|rights reserved|terms of |privacy policy|lorem ipsum|rechte vorbehalten|nutzungsbedingungen|datenschutz|"
    "droits r|d'utilisation|de confidentialit|derechos reservados|de uso|de servicio|de privacidad|nuestro bolet"
).split("|")

RULES = ("punctuation", "repetition", "symbols", "shouting", "navigation", "boilerplate")


def _holds(line: Column, parts: Iterable[str]) -> Column:
    """Whether any of ``parts`` is in the line."""
    return reduce(lambda a, b: a | b, [line.contains(F.lit(x)) for x in parts])


def _count(line: Column, pattern: str) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, pattern, ""))


def line_words(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(SPACE)), r"\s+")


def failures(line: Column, words: Column) -> dict[str, Column]:
    """For each rule whether a line (not blank) of these words fails it."""
    n_words = F.size(words)
    again = F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))
    visible = F.length(F.regexp_replace(line, r"\s", ""))
    low = F.lower(line)
    return {
        "punctuation": (n_words >= LONG_LINE_WORDS) & ~line.rlike(END_MARK),
        "repetition": again > MAX_REPEAT_RATIO * n_words,
        "symbols": line.rlike(SYMBOLS) & (_count(line, SYMBOLS) > MAX_SYMBOL_RATIO * visible),
        "shouting": line.contains("!!") & (_count(line, _SHOUTED) > MAX_SHOUT_RATIO * F.length(line)),
        "navigation": (_holds(line, _BARS) & line.rlike(NAVIGATION)) | ((n_words <= _MENU_WORDS) & low.rlike(MENU)),
        "boilerplate": _holds(low, _OF_BOILERPLATE) & low.rlike(BOILERPLATE),
    }


def line_passes(line: Column, words: Column) -> Column:
    bad = F.lit(False)
    for x in failures(line, words).values():
        bad = bad | x
    return ~bad


def clean_lines(docs: DataFrame, min_kept: float = MIN_KEPT, text_col: str = "text") -> DataFrame:
    """``docs`` with failing lines taken out of ``text_col``; documents that keep less than ``min_kept`` go.

    Two columns more: lines_in and lines_kept, which count lines with a visible character. What a document
    keeps is measured in characters of such lines. Lines without a visible character stay. Documents whose
    text is null, empty or without a visible character are rejected: there is nothing to keep. Null in other
    columns doesn't matter; repeated rows are judged alike; there are no ties, as rows are judged by themselves.
    Texts are judged whole, however long. An empty table gives an empty one. A new column that clashes gets a ``_``
    before its name.
    """
    lines_in, lines_kept, parts, kept = fresh(docs, "lines_in", "lines_kept", "parts", "kept")
    text = docs[f"`{text_col}`"]
    blank = lambda x: F.btrim(x, F.lit(SPACE)) == ""
    split = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), blank(x).alias("blank"), line_words(x).alias("words")))
    judge = lambda x: F.struct(x["line"].alias("line"), x["blank"].alias("blank"), (x["blank"] | line_passes(x["line"], x["words"])).alias("ok"))
    # a generator of one row, which Catalyst doesn't push filters through: else lines would be judged twice
    judged = docs.select("*", F.explode(F.array(F.transform(split, judge))).alias(parts))
    length = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(x["blank"], 0).otherwise(F.length(x["line"])))
    judged = judged.withColumn(kept, F.filter(parts, lambda x: x["ok"]))
    judged = judged.where((length(F.col(parts)) > 0) & (length(F.col(kept)) >= min_kept * length(F.col(parts))))
    new = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    count = lambda c: F.size(F.filter(c, lambda x: ~x["blank"]))
    cols = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return judged.select(*cols, count(parts).alias(lines_in), count(kept).alias(lines_kept))


def op3(spark, sf_dir: str) -> DataFrame:
    """``documents`` that pass, cleaned: doc_id, text, lines_in, lines_kept."""
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_count(pattern: str) -> str:
    return f"length(line) - length(regexp_replace(line, {_q(pattern)}, '', 'g'))"


OP3_SQL = f"""
WITH l AS (
  SELECT doc_id, text, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
),
j AS (
  SELECT *, regexp_replace(line, '\\s', '', 'g') = '' AS blank,
    NOT ((len(w) >= {LONG_LINE_WORDS} AND NOT regexp_matches(line, {_q(END_MARK)}))
      OR len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > {MAX_REPEAT_RATIO} * len(w)
      OR {_sql_count(SYMBOLS)} > {MAX_SYMBOL_RATIO} * length(regexp_replace(line, '\\s', '', 'g'))
      OR {_sql_count(SHOUTED)} > {MAX_SHOUT_RATIO} * length(line)
      OR regexp_matches(line, {_q(NAVIGATION)}) OR regexp_matches(lower(line), {_q(MENU)}) OR regexp_matches(lower(line), {_q(BOILERPLATE)})) AS ok
  FROM (SELECT *, regexp_split_to_array(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+') AS w FROM l)
),
g AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE ok OR blank), '') AS text,
    CAST(count(*) FILTER (WHERE NOT blank) AS INTEGER) AS lines_in, CAST(count(*) FILTER (WHERE ok AND NOT blank) AS INTEGER) AS lines_kept,
    coalesce(sum(length(line)) FILTER (WHERE NOT blank), 0) AS a, coalesce(sum(length(line)) FILTER (WHERE ok AND NOT blank), 0) AS b
  FROM j GROUP BY doc_id
)
SELECT doc_id, text, lines_in, lines_kept FROM g WHERE a > 0 AND b >= {MIN_KEPT} * a
"""
