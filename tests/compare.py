"""Spark query against SQL on the same files: rows, column names and values."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, bytearray):
        return bytes(x)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, [tuple(map(plain, r)) for r in got.fetchall()]


def assert_same(df, sql, sf_dir):
    names, want = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    assert len(got) == len(want)
    assert Counter(got) == Counter(want)
