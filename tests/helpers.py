"""Comparison of a query with its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(df):
    return sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def oracle_rows(sql, folder):
    con = duckdb.connect(config={"memory_limit": "2GB"})
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rel.fetchall()), key=repr)
