"""Secret scan with an incremental ledger of blobs.

Every historical version of every path is addressed by the SHA-256 of its content. The ledger says which (blob,
rule version) pairs have been scanned and what was found; only pairs that it lacks are scanned, each blob once
however many paths hold it, and findings are joined back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, pick, written


class Rule(NamedTuple):
    rule: str
    version: int
    anchors: tuple[str, ...]  # a line with a match has one of these, in lower case
    pattern: str  # matched within lines; the same meaning in RE2's syntax

    @property
    def key(self) -> str:
        return f"{self.rule}@{self.version}"


RULES: tuple[Rule, ...] = (
    Rule("aws-access-key-id", 1, ("akia", "asia"), r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    Rule("github-token", 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"\bgh[pousr]_[0-9A-Za-z]{36,255}\b"),
    Rule("github-pat", 1, ("github_pat_",), r"\bgithub_pat_[0-9A-Za-z_]{22,255}\b"),
    Rule("gitlab-pat", 1, ("glpat-",), r"\bglpat-[0-9A-Za-z_-]{20,}"),
    Rule("slack-token", 1, ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"\bxox[baprs]-[0-9A-Za-z-]{10,}"),
    Rule("google-api-key", 1, ("aiza",), r"\bAIza[0-9A-Za-z_-]{35}"),
    Rule("stripe-key", 1, ("sk_live_", "rk_live_", "sk_test_"), r"\b(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("npm-token", 1, ("npm_",), r"\bnpm_[0-9A-Za-z]{36}\b"),
    Rule("json-web-token", 1, ("eyj",), r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    Rule("private-key", 1, ("private key",), r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"),
    Rule("url-password", 1, ("://",), r"\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s:@]{3,}@[^/\s]+"),
    Rule("assigned-secret", 1, ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "auth_key"), r"""(?i:\b[a-z0-9_.-]*(?:token|secret|password|passwd|api_?-?key|access_key|auth_key)["']?\s*(?:=|:=|:|=>)\s*["'][^\s"']{8,}["'])"""),
)

#: The rules of the round before, in which an assigned secret was looked for after ``=`` and ``:`` only.
PREVIOUS: tuple[Rule, ...] = tuple(r._replace(version=0, pattern=r.pattern.replace("(?:=|:=|:|=>)", "(?:=|:)")) if r.rule == "assigned-secret" else r for r in RULES)

FINDING = "blob string, rule string, rule_version int, line_no int, match_no int, length int, secret_sha256 string, redacted string"
LEDGER = "blob string, rule_key string, findings int"
FINDING_COLUMNS = [c.split()[0] for c in FINDING.split(", ")]
#: So many unseen blobs are broadcast (about 100 bytes each), and contents stay where they are; more meet them in a shuffle.
BROADCAST_BLOBS = 500_000


def blob_of(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def scan_text(text: str, rules: Sequence[tuple[Rule, re.Pattern]]) -> list[tuple]:
    """(rule, version, line number from 0, number in its line from 0, length, hash, redacted) of each match."""
    out = []
    low = text.lower()
    for rule, pattern in rules:
        if not any(a in low for a in rule.anchors):
            continue
        for n, line in enumerate(text.split("\n")):
            for k, m in enumerate(pattern.finditer(line)):
                s = m.group()
                out.append((rule.rule, rule.version, n, k, len(s), hashlib.sha256(s.encode()).hexdigest(), s[:4] + "*" * 4))
    return out


def _scan(rules: Sequence[Rule]):
    """(blob, content, numbers of rules) -> findings, and rows of the ledger; each blob once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, re.compile(r.pattern, re.ASCII)) for r in rules]
        seen: set[bytes] = set()
        for b in batches:
            found, scanned = [], []
            for blob, text, todo in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (address := bytes.fromhex(blob)) in seen:
                    continue
                seen.add(address)
                own = [(blob, *f) for f in scan_text(text, [compiled[k] for k in todo])]
                count = dict.fromkeys((rules[k].rule for k in todo), 0)
                for f in own:
                    count[f[1]] += 1
                found += own
                scanned += [(blob, rules[k].key, count[rules[k].rule]) for k in todo]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            none, rest = [None] * len(scanned), [None] * len(found)
            columns = {n: ([f[k] for f in found] + none, t) for k, (n, t) in enumerate(zip(FINDING_COLUMNS, kinds))}
            columns["blob"] = ([f[0] for f in found] + [r[0] for r in scanned], pa.string())
            yield batch_of(columns | {"rule_key": (rest + [r[1] for r in scanned], pa.string()), "findings": (rest + [r[2] for r in scanned], pa.int32())})

    return run


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, broadcast_blobs: int = BROADCAST_BLOBS) -> DataFrame:
    """Scan what the ledger lacks. versions(path, content) -> findings, and rows for the ledger (rule_key not null).

    What is to be scanned is found out from hashes alone. One path of each unseen blob then brings its content: where
    up to ``broadcast_blobs`` are unseen these are sent to the contents, so that no content moves; beyond that
    both are shuffled by blob. Findings and ledger are the same.
    """
    addressed = versions.where("content is not null").withColumn("blob", blob_of(F.col("content")))
    blobs = addressed.groupBy("blob").agg(F.min("path").alias("at"))
    every = F.lit([r.key for r in rules]).cast("array<string>") if rules else F.array().cast("array<string>")
    if ledger is None:
        todo = blobs.withColumn("keys", every)
    else:
        done = ledger.groupBy("blob").agg(F.collect_set("rule_key").alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn("keys", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    number = F.transform("keys", lambda k: (F.array_position(every, k) - 1).cast("int"))
    todo = cut(todo.where(F.size("keys") > 0).select(F.xxhash64("blob").alias("hash"), F.col("blob").alias("b"), "at", number.alias("todo")))
    # blobs that no path names come by any of their rows
    same = (F.xxhash64("blob") == F.col("hash")) & F.col("path").eqNullSafe(F.col("at"))
    if todo.count() <= broadcast_blobs:
        unseen = addressed.join(F.broadcast(todo.drop("b")), same)
    else:
        unseen = addressed.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("at")))
    return unseen.select("blob", "content", "todo").mapInArrow(_scan(rules), f"{FINDING}, rule_key string, findings int")


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, rules: Sequence[Rule] = RULES, path_col: str = "path", content_col: str = "content", broadcast_blobs: int = BROADCAST_BLOBS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings by path, new ledger rows, new findings by blob) of versions(path, content), old and current alike.

    ``ledger(blob, rule_key, findings)`` and ``known`` (findings by blob, each of a rule's version) are what earlier
    calls returned: append the new rows to them. Of known findings only those of the given rules in the given versions
    count, so a rule whose version changed is scanned anew and its old findings are gone. The scan runs once, into a
    table of the shared folder, which all three results read.

    A path that held the same content twice, and a row that is repeated, is reported once; a null path is one more
    path; null contents have no blob and no findings; an empty content is a blob like others. Of equal contents it
    makes no difference which path brings them. Contents are scanned whole, line by line, however long. Secrets are
    never returned: their length, SHA-256 and first four characters are. Columns but those named are ignored,
    whatever their names. Empty tables, and no rules, give empty results.
    """
    own = pick(versions, path=path_col, content=content_col)
    new = written(scan_blobs(own, ledger, rules, broadcast_blobs), "secret-scan")
    findings = new.where("rule_key is null").select(*FINDING_COLUMNS).dropDuplicates(["blob", "rule", "line_no", "match_no"])
    rows = new.where("rule_key is not null").select("blob", "rule_key", "findings").dropDuplicates(["blob", "rule_key"])
    every = findings if known is None else findings.unionByName(known.select(*FINDING_COLUMNS)).dropDuplicates(["blob", "rule", "rule_version", "line_no", "match_no"])
    return on_paths(own, every, rules), rows, findings


def on_paths(own: DataFrame, findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """path and finding, for every path of each finding's blob, of the rules in their present versions."""
    paths = own.where("content is not null").select("path", blob_of(F.col("content")).alias("blob")).distinct()
    current = findings.where(F.concat_ws("@", "rule", "rule_version").isin([r.key for r in rules]))
    return paths.join(current, "blob").select("path", "blob", "rule", "rule_version", "line_no", "match_no", "length", "secret_sha256", "redacted")


def op9(spark, sf_dir: str) -> DataFrame:
    """Secrets in ``documents``, each a version of the path doc_id, in two rounds: half of the versions under the
    rules before, which leaves a ledger; then all versions, of which only unseen pairs are scanned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    _, ledger, known = scan_secrets(docs.where("pmod(xxhash64(path), 2) = 0"), rules=PREVIOUS)
    return scan_secrets(docs, ledger, known)[0].withColumnRenamed("path", "doc_id")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_EACH = " UNION ALL ".join(f"SELECT doc_id, blob, '{r.rule}' AS rule, {r.version} AS rule_version, i, regexp_extract_all(line, {_sql(r.pattern)}) AS m FROM l" for r in RULES)
OP9_SQL = rf"""
WITH l AS (
  SELECT doc_id, sha256(text) AS blob, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
),
e AS ({_EACH}),
u AS (SELECT DISTINCT doc_id, blob, rule, rule_version, i, k, m[k] AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM e))
SELECT doc_id, blob, rule, rule_version, CAST(i - 1 AS INTEGER) AS line_no, CAST(k - 1 AS INTEGER) AS match_no, CAST(length(s) AS INTEGER) AS length,
  sha256(s) AS secret_sha256, s[1:4] || '****' AS redacted
FROM u
"""
