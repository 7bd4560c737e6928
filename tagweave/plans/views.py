"""Tables of symbols, procedures, limits, detections and segments, derived from the star schema.

The SQL means the same to Spark and to DuckDB; ``{lineitem}`` and the like stand for tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_rows

_TAG_NUMBER = "lpad(CAST({} AS STRING), 3, '0')"
_EQUIPMENT = "'E-' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') || '-' || CAST(CAST(floor(p_partkey / 10000) AS INT) AS STRING)"

_SYM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_SYM_ORD = f"row_number() OVER (PARTITION BY l_orderkey % 3 ORDER BY {', '.join(_SYM_ORDER)}) AS ord"

VIEWS = {
    "sym": f"""SELECT CAST(l_orderkey % 3 AS INT) AS page,
  {_SYM_ORD},
  CASE l_partkey % 5 WHEN 0 THEN 'circle' WHEN 1 THEN 'rectangle' WHEN 2 THEN 'bowtie' WHEN 3 THEN 'circle_triangle' ELSE 'unknown' END AS kind,
  CAST((l_partkey * 37) % 3300 AS INT) AS x, CAST((l_suppkey * 91 + l_orderkey * 17) % 5100 AS INT) AS y,
  CAST(20 + l_partkey % 90 AS INT) AS w, CAST(20 + l_orderkey % 150 AS INT) AS h,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE
    (CASE l_suppkey % 6 WHEN 0 THEN 'MV' WHEN 1 THEN 'PSV' WHEN 2 THEN 'P' WHEN 3 THEN 'T' WHEN 4 THEN 'PI' ELSE 'ZZ' END)
    || '-' || {_TAG_NUMBER.format("l_partkey % 1000")} END AS tag
FROM {{lineitem}}""",
    "sop": f"""SELECT o_orderkey AS doc_id, 'Open valve MV-' || {_TAG_NUMBER.format("o_custkey % 1000")} || ' slowly. P-'
  || {_TAG_NUMBER.format("o_custkey % 700")} || ' connects to T-' || {_TAG_NUMBER.format("o_orderkey % 900")}
  || '. Inspect ' || CASE o_orderkey % 4 WHEN 0 THEN 'pump' WHEN 1 THEN 'vessel' ELSE 'tank' END
  || ' T-' || {_TAG_NUMBER.format("o_orderkey % 900")} || ' monthly.' AS full_text
FROM {{orders}}""",
    "lim_p": f"""SELECT {_EQUIPMENT} AS tag, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS design_pressure_psig,
  CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN '3/' || CAST(p_size AS STRING)
    WHEN 2 THEN '1-' || CAST(p_size AS STRING) ELSE NULL END AS design_temperature_f
FROM {{part}}""",
    "lim_s": f"""SELECT {_EQUIPMENT} AS tag, 1 AS row_no, p_retailprice + (p_partkey % 5) * 0.25 AS pressure_psig, CAST(p_size AS STRING) AS temperature_f
FROM {{part}} WHERE p_partkey % 13 <> 0
UNION ALL
SELECT {_EQUIPMENT} AS tag, 2 AS row_no, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice + 10 END AS pressure_psig, '3' || CAST(p_size AS STRING) AS temperature_f
FROM {{part}} WHERE p_partkey % 2 = 0""",
    "det": """SELECT CAST(user_id AS BIGINT) AS page, event_id AS ord, event_type AS class_name, value AS confidence,
  CAST((event_id * 7919) % 600 AS INT) AS x0, CAST((event_id * 104729) % 400 AS INT) AS y0,
  CAST((event_id * 7919) % 600 + 60 + event_id % 40 AS INT) AS x1, CAST((event_id * 104729) % 400 + 60 + event_id % 30 AS INT) AS y1
FROM {events}""",
    "drw": """SELECT CAST(l_orderkey % 3 AS INT) AS page, l_orderkey * 8 + l_linenumber AS draw_id,
  CASE l_suppkey % 5 WHEN 0 THEN 'f' WHEN 1 THEN 'fs' ELSE 's' END AS type,
  CASE WHEN l_orderkey % 9 = 0 THEN 're' WHEN l_linenumber IN (1, 6) THEN 'c' ELSE 'l' END AS op,
  CAST(CASE l_linenumber WHEN 1 THEN 4 WHEN 2 THEN 18 + l_orderkey % 15 WHEN 3 THEN 11 + l_orderkey % 3 WHEN 4 THEN 55 + l_orderkey % 40
    WHEN 5 THEN 38 + l_orderkey % 20 WHEN 6 THEN 1 + l_orderkey % 3 ELSE 1 END AS INT) AS n,
  CAST(CASE WHEN l_orderkey % 4 = 0 THEN 3 ELSE 1 END AS DOUBLE) / 4 AS gap,
  CAST((l_partkey * 37) % CASE WHEN l_linenumber = 6 AND l_orderkey % 4 = 0 THEN 80 ELSE 2300 END AS DOUBLE) / 2 AS x0,
  CAST((l_suppkey * 91 + l_orderkey * 17) % CASE WHEN l_linenumber = 6 AND l_orderkey % 4 = 0 THEN 60 ELSE 1500 END AS DOUBLE) / 2 AS y0,
  CAST(CASE l_linenumber WHEN 1 THEN 26 + l_partkey % 17 WHEN 2 THEN 17 + l_partkey % 14 WHEN 3 THEN 8 + l_partkey % 520 WHEN 4 THEN 150 + l_partkey % 120
    WHEN 5 THEN 12 + l_partkey % 36 WHEN 6 THEN 2 + l_partkey % 20 ELSE l_partkey % 900 END AS DOUBLE) / 2 AS wide,
  CAST(CASE l_linenumber WHEN 1 THEN 26 + l_suppkey % 15 WHEN 2 THEN 17 + l_suppkey % 14 WHEN 3 THEN 8 + l_suppkey % 50 WHEN 4 THEN 24 + l_suppkey % 56
    WHEN 5 THEN 90 + l_suppkey % 80 WHEN 6 THEN 2 + l_suppkey % 60 ELSE l_suppkey % 8 END AS DOUBLE) / 2 AS high
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber)""",
    "pgs": """SELECT CAST(page AS INT) AS page, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, CAST(dpi AS INT) AS dpi,
  CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d, CAST(e AS DOUBLE) AS e, CAST(f AS DOUBLE) AS f
FROM (VALUES (0, 1150, 750, 150, 1, 0, 0, 1, 0, 0), (1, 750, 1150, 300, 0, 1, -1, 0, 750, 0), (2, 1150, 750, 72, 1, 0, 0, -1, 0, 750)) AS t(page, width, height, dpi, a, b, c, d, e, f)""",
    "ctr": """SELECT CAST(CAST(floor(o_orderkey / 4) AS BIGINT) % 3 AS INT) AS page, CAST(o_orderkey AS INT) AS idx,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_orderkey - o_orderkey % 4 END AS INT) AS parent, CAST(area AS DOUBLE) AS area,
  CAST((o_custkey * 31) % 400 AS DOUBLE) AS perimeter, CAST(3 + o_custkey % 8 AS INT) AS vertices, CAST(area * (20 + o_custkey % 4) AS DOUBLE) / 20 AS hull_area,
  CAST(o_custkey % 2000 AS INT) AS x, CAST(o_orderkey % 1500 AS INT) AS y, CAST(10 + o_custkey % 120 AS INT) AS w, CAST(10 + o_orderkey % 90 AS INT) AS h
FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 500 + (o_custkey * 13) % 9000 ELSE (o_custkey * 7) % 5000 END AS area FROM {orders})""",
    "wrd": """SELECT CAST(l_partkey % 300 AS INT) AS page, l_orderkey * 8 + l_linenumber AS ord,
  CASE l_orderkey % 8 WHEN 0 THEN 'E-' || num WHEN 1 THEN 'v=' || num WHEN 2 THEN 'T/' || num || '!' WHEN 3 THEN '  f—' || num WHEN 4 THEN 'MV-' || num
    WHEN 5 THEN 'note' WHEN 6 THEN 'P-' || num || 'A' ELSE 'AC–' || num || ' ' END AS text,
  CAST((l_partkey * 37) % 1000 AS INT) AS left, CAST((l_suppkey * 91 + l_orderkey * 17) % 800 AS INT) AS top,
  CAST(20 + l_suppkey % 30 AS INT) AS width, CAST(10 + l_orderkey % 7 AS INT) AS height
FROM (SELECT *, CAST(100 + l_partkey % 900 AS STRING) AS num FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) WHERE l_linenumber <= 2)""",
    "rep": """SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'Valve, Gate Valve' WHEN 1 THEN ' equipment , Heat Exchanger!' WHEN 2 THEN 'pump' WHEN 3 THEN 'INSTRUMENT'
  WHEN 4 THEN 'valve, nonsense' WHEN 5 THEN 'tag reads e-' || num WHEN 6 THEN 'MV   ' || num || 'A' WHEN 7 THEN ' unknown ' WHEN 8 THEN 'P=' || num WHEN 9 THEN '' ELSE 'AC-' || num || '-12, T—' || num END AS reply
FROM (SELECT *, CAST(10 + p_size % 90 AS STRING) AS num FROM {part})""",
    "hdr": """SELECT CAST(c_custkey AS INT) AS page, CASE c_custkey % 5 WHEN 0 THEN 'F-' || num || ' C & D  DESIGN: ' || num || '.5 PSIG @ 95F, V-320 SEE SHEET' WHEN 1 THEN 'mv=' || num || ' M.W.P. ' || num || ' psig @ -20 to 85 F'
  WHEN 2 THEN 'AC-340 MWP 265 PSIG @ ' || num || 'F / E—350 MWP ' || num || ' PSIG @ 155/200F' WHEN 3 THEN 'P-' || num || ' AND P-1 DESIGN 10 PSIG' ELSE 'NO LIMITS ' || num END AS text
FROM (SELECT *, CAST(100 + c_custkey % 400 AS STRING) AS num FROM {customer})""",
    "seg": """SELECT CAST(l_orderkey % 3 AS INT) AS page, l_orderkey * 8 + l_linenumber AS seg_id,
  CAST((l_partkey * 37 + l_linenumber) % 3300 AS DOUBLE) AS x1, CAST((l_suppkey * 91 + l_orderkey * 17) % 5100 AS DOUBLE) AS y1,
  CAST((l_suppkey * 53) % 3300 AS DOUBLE) AS x2, CAST((l_orderkey * 29) % 5100 AS DOUBLE) AS y2
FROM {lineitem} WHERE l_linenumber = 1""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    if name == "sym":
        # three pages would be three tasks: the same numbers, by slices of orders
        lines = tables["lineitem"].select(*_SYM_ORDER).withColumn("page", F.expr("l_orderkey % 3"))
        tables["lineitem"] = number_rows(lines, ["page"], _SYM_ORDER, "nth")
        sql = sql.replace(_SYM_ORD, "CAST(nth AS INT) AS ord")
    return spark.sql(sql, **tables)


def sql_view(name: str) -> str:
    """The view as DuckDB SQL over the tables' own names."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])
