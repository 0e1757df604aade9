"""Runs queries beside their SQL in DuckDB and compares all rows."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def differ(df, sql, sf_dir):
    a, b = spark_rows(df), duck_rows(sql, sf_dir)
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    if a[1] != b[1]:
        return f"{len(a[1])} and {len(b[1])} rows; only left {[x for x in a[1] if x not in set(b[1])][:3]}; only right {[x for x in b[1] if x not in set(a[1])][:3]}"
    return ""
