"""Runs a query and its SQL on the same tables and compares schemas and rows."""

import glob
import math
import os

import duckdb

INTS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    mine = {n: INTS.get(t, t) for n, t in df.dtypes}
    theirs = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    assert mine == theirs, f"schema {mine} != {theirs}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(rel.columns, rel.fetchall())
    assert len(got) == len(want), f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        assert g == w, f"{g} != {w}"
    return len(got)
