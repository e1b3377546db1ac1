"""Spark results against DuckDB's on the same files."""

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return list(map(plain, x)) if isinstance(x, list) else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr), [columns[i] for i in order]


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want, wanted = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert names == wanted, (names, wanted)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w, f"{names}\n{g}\n{w}"
    return len(got)
