"""Rows of a registered query and of its DuckDB SQL, ready to compare."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def both(spark, folder, query, sql):
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    return got, sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
