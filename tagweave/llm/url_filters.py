"""URL filters: many glob rules at once by a bit-parallel wildcard automaton.

All rules are packed into one multiword Shift-And automaton. A rule's pattern characters are consecutive
bits; ``?`` is a bit that every character sets; ``*`` is a self-loop on the bit before it. A batch of
canonical URLs is simulated together, one character position at a time, as (urls x words) uint64 arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import fresh


class Rule(NamedTuple):
    rule_id: int
    action: str  # block or allow
    category: str
    glob: str  # * any run of characters, ? one character; the whole canonical URL must match


_BLOCKED_PATHS = ("login", "signin", "signup", "register", "cart", "checkout", "basket", "wp-admin", "wp-login.php", "admin", "search", "tag", "share", "print", "cgi-bin", "trackback", "xmlrpc.php", "feed", "calendar", "session")
_BLOCKED_HOSTS = ("ads", "adserver", "doubleclick", "tracker", "tracking", "analytics", "pixel", "casino", "poker", "porn", "xxx", "viagra", "torrent", "warez", "proxy", "spam", "phish", "malware")
_BLOCKED_FILES = ("exe", "zip", "gz", "jpg", "jpeg", "png", "gif", "mp4", "mp3", "pdf", "css", "js", "woff2", "ico")
RULES: tuple[Rule, ...] = tuple(
    Rule(n, *r)
    for n, r in enumerate(
        [("block", "path", f"*://*/{x}") for x in _BLOCKED_PATHS]
        + [("block", "path", f"*://*/{x}/*") for x in _BLOCKED_PATHS]
        + [("block", "path", f"*://*/{x}?*") for x in _BLOCKED_PATHS]
        + [("block", "host", f"*://{x}.*/*") for x in _BLOCKED_HOSTS]
        + [("block", "host", f"*://*.{x}.*/*") for x in _BLOCKED_HOSTS]
        + [("block", "file", f"*.{x}") for x in _BLOCKED_FILES]
        + [("block", "referral", "*://*ref=*"), ("block", "session", "*sessionid=*"), ("block", "paging", "*page=??*"), ("block", "mobile", "*://m.*.net/*"), ("block", "digits", "*://*/*/??4"), ("allow", "docs", "*://*.example.org/*"), ("allow", "front page", "*://*.*/?"), ("allow", "english", "*://*.example.com/en/*")],
        start=1,
    )
)


class Automaton:
    """Multiword Shift-And over the UTF-8 bytes of globs; ``?`` takes the first byte of a character and keeps to it."""

    def __init__(self, globs: Sequence[str]) -> None:
        bits: list[int | None] = []  # byte, or None for any
        first, final, loops, begin = [], [], [], []  # bit numbers; begin: rules that start with *
        self.trivial = []  # rules of nothing but *, and the empty rule: matches decided by length
        self.final_of: list[int] = []
        for g in globs:
            start = len(bits)
            star_first = g.startswith("*")
            for c in g.encode():
                if c == 0x2A:
                    if len(bits) > start:
                        loops.append(len(bits) - 1)
                else:
                    bits.append(None if c == 0x3F else c)
            if len(bits) == start:
                self.final_of.append(-1)
                self.trivial.append(bool(g))
                continue
            self.trivial.append(False)
            first.append(start)
            if star_first:
                begin.append(start)
            final.append(len(bits) - 1)
            self.final_of.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))

        def pack(at) -> np.ndarray:
            out = np.zeros(self.words, dtype=np.uint64)
            for b in at:
                out[b // 64] |= np.uint64(1 << (b % 64))
            return out

        self.first, self.begin, self.final = pack(first), pack(begin), pack(final)
        inside = [0x80 <= byte < 0xC0 for byte in range(256)]  # bytes that go on with a character
        self.mask = np.stack([pack([b for b, c in enumerate(bits) if c == byte or c is None and not inside[byte]]) for byte in range(256)])
        anyone = [b for b, c in enumerate(bits) if c is None]
        self.stay = np.stack([pack(loops + anyone * inside[byte]) for byte in range(256)])

    def run(self, urls: Sequence[bytes]) -> np.ndarray:
        """(urls x words): the final bits that are set after the last character of each URL."""
        n = len(urls)
        state = np.zeros((n, self.words), dtype=np.uint64)
        if not n:
            return state
        lengths = np.array([len(u) for u in urls])
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        flat = np.frombuffer(b"".join(urls[k] for k in order) + b"\0", dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        s = np.zeros((n, self.words), dtype=np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for pos in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -pos, side="left"))  # those longer than pos
            d = s[:live]
            shifted = d << one
            shifted[:, 1:] |= d[:, :-1] >> top
            shifted &= ~self.first
            shifted |= self.first if pos == 0 else self.begin
            byte = flat[starts[:live] + pos]
            s[:live] = (shifted & self.mask[byte]) | (d & self.stay[byte])
        state[order] = s & self.final
        return state

    def matches(self, urls: Sequence[bytes]) -> list[list[int]]:
        """For each URL the numbers (from 0) of the globs that match it."""
        state = self.run(urls)
        out: list[list[int]] = [[] for _ in urls]
        for rule, bit in enumerate(self.final_of):
            if bit < 0:
                hit = [k for k, u in enumerate(urls) if self.trivial[rule] or not u]
            else:
                hit = np.flatnonzero(state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1))
            for k in hit:
                out[k].append(rule)
        return out


#: What needn't be written as a percent code, by its code.
UNRESERVED = {f"{ord(c):02X}": c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"}


def _decoded(text: Column) -> Column:
    """Percent codes of unreserved characters as these, others in upper case; what is no code stays."""
    table = F.create_map(*[F.lit(x) for kv in UNRESERVED.items() for x in kv])

    def one(part: Column, i: Column) -> Column:
        code = F.upper(F.substring(part, 1, 2))
        rest = F.substring(part, 3, 1 << 30)
        return F.when(i == 0, part).when(~code.rlike("^[0-9A-F]{2}$"), F.concat(F.lit("%"), part)).otherwise(F.concat(F.coalesce(F.try_element_at(table, code), F.concat(F.lit("%"), code)), rest))

    return F.when(text.contains("%"), F.array_join(F.transform(F.split(text, "%"), one), "")).otherwise(text)


def _resolved(path: Column) -> Column:
    """A path without ``.`` and ``..``."""
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x))
    out = F.aggregate(F.slice(parts, 2, 1 << 30), F.lit(""), step)
    out = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(out, F.lit("/"))).otherwise(out)
    return F.when(path.contains("/."), F.when(out == "", "/").otherwise(out)).otherwise(path)


def canonical(url: Column) -> Column:
    """Trimmed; scheme and host in lower case; without user, default port, fragment, ``www.`` and dots after the host;
    ``/`` for no path; percent codes of unreserved characters decoded and dot segments resolved; http for no scheme."""
    u = F.regexp_replace(url, r"^\s+|\s+$", "")
    u = F.regexp_replace(u, "#.*$", "")
    u = F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), u).when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(F.concat(F.lit("http://"), u))
    head = F.lower(F.regexp_extract(u, "^([^/]*://[^/?]*)", 1))
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    for pattern, by in (("://[^@]*@", "://"), ("^(http://.*):80$", "$1"), ("^(https://.*):443$", "$1"), (r"://www\.", "://"), (r"\.+(:[0-9]+)?$", "$1")):
        head = F.regexp_replace(head, pattern, by)
    rest = _decoded(F.concat(F.when(rest.startswith("/"), "").otherwise("/"), rest))
    path = F.regexp_extract(rest, "^[^?]*", 0)
    return F.concat(head, _resolved(path), F.substring(rest, F.length(path) + 1, F.length(rest)))


def matching_rules(rules: Sequence[Rule]):
    automata: list[Automaton] = []

    @F.pandas_udf(ArrayType(IntegerType()))
    def match(url: pd.Series) -> pd.Series:
        if not automata:
            automata.append(Automaton([r.glob for r in rules]))
        known = url.notna().to_numpy()
        found = iter(automata[0].matches([u.encode() for u in url[known]]))
        return pd.Series([sorted(rules[k].rule_id for k in next(found)) if k else None for k in known], dtype=object)

    return match


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with three columns more: canonical_url, rules (ids of all that match, sorted) and blocked.

    A URL is blocked if a block rule matches and no allow rule does. A null URL has null canonical_url and
    rules and isn't blocked; an empty one is canonically ``http:///``. URLs are matched whole, however long. Repeated
    rows are judged alike; there are no ties, as all rules that match are returned. An empty table gives an empty one. New
    columns that clash with those of ``pages`` get a ``_`` before their names. Rules are a fixed list of the
    caller's, not data: the automaton takes (rules x length) / 8 bytes x 256 on each worker.
    """
    canon, hits, blocked = fresh(pages, "canonical_url", "rules", "blocked")
    of = lambda action: F.array(*[F.lit(r.rule_id) for r in rules if r.action == action]).cast("array<int>")
    out = pages.withColumn(canon, canonical(pages[f"`{url_col}`"]))
    out = out.withColumn(hits, matching_rules(tuple(rules))(F.col(canon)))
    verdict = F.arrays_overlap(hits, of("block")) & ~F.arrays_overlap(hits, of("allow"))
    return out.withColumn(blocked, F.coalesce(verdict, F.lit(False)))


def op6(spark, sf_dir: str) -> DataFrame:
    """All ``pages``: page_id, canonical_url, rules, blocked."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "canonical_url", "rules", "blocked")


_UNRESERVED = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in UNRESERVED.items()) + "}"
_RULE_ROWS = ", ".join(f"({r.rule_id}, '{r.action}', '{r.glob}')" for r in RULES)
OP6_SQL = rf"""
WITH r(rule_id, action, pat) AS (VALUES {_RULE_ROWS}),
t AS (SELECT page_id, regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '#.*$', '') AS u FROM pages),
s AS (SELECT page_id, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN u WHEN starts_with(u, '//') THEN 'http:' || u ELSE 'http://' || u END AS u FROM t),
h AS (SELECT page_id, u, regexp_extract(u, '^([^/]*://[^/?]*)', 1) AS head FROM s),
k AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(head), '://[^@]*@', '://'), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1'), '://www\.', '://'), '\.+(:[0-9]+)?$', '\1') AS head,
    CASE WHEN starts_with(substr(u, length(head) + 1), '/') THEN '' ELSE '/' END || substr(u, length(head) + 1) AS rest
  FROM h
),
w AS (SELECT page_id, head, list_aggregate(list_transform(string_split(rest, '%'), lambda x, i: CASE WHEN i = 1 THEN x WHEN NOT regexp_matches(upper(x[1:2]), '^[0-9A-F][0-9A-F]$') THEN '%' || x
    ELSE coalesce({_UNRESERVED}[upper(x[1:2])], '%' || upper(x[1:2])) || x[3:] END), 'string_agg', '') AS rest FROM k),
q AS (SELECT page_id, head, regexp_extract(rest, '^[^?]*') AS path, substr(rest, length(regexp_extract(rest, '^[^?]*')) + 1) AS query FROM w),
z AS (SELECT *, list_reduce(list_prepend('', string_split(path, '/')[2:]), lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || x END)
    || CASE WHEN string_split(path, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END AS short FROM q),
c AS (SELECT page_id, head || CASE WHEN NOT contains(path, '/.') THEN path WHEN short = '' THEN '/' ELSE short END || query AS canonical_url FROM z),
m AS (SELECT page_id, rule_id, action FROM c JOIN r ON canonical_url GLOB pat),
g AS (SELECT page_id, list(DISTINCT rule_id ORDER BY rule_id) AS rules, bool_or(action = 'block') AND NOT bool_or(action = 'allow') AS blocked FROM m GROUP BY page_id)
SELECT c.page_id, c.canonical_url, CASE WHEN c.canonical_url IS NOT NULL THEN coalesce(g.rules, []) END AS rules, coalesce(g.blocked, false) AS blocked
FROM c LEFT JOIN g USING (page_id)
"""
