"""Compares a query with its SQL on the same tables in DuckDB."""

import math
import os
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (datetime, date)):
        return str(value)[:19]
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, sql: str, sf_dir: str) -> int:
    con = connect(sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    want = rows([c[0] for c in con.description], con.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    return len(got[1])
