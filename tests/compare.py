"""Spark results against DuckDB's on the same Parquet tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(value(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(sql: str, sf_dir: str):
    with duckdb.connect() as con:
        for p in Path(sf_dir).glob("*.parquet"):
            source = f"{p}/*.parquet" if p.is_dir() else str(p)
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
        got = con.execute(sql)
        columns = [c[0] for c in got.description]
        return rows_of(columns, got.fetchall())


def assert_same(df, sql: str, sf_dir: str):
    columns, ours = spark_rows(df)
    names, theirs = duck_rows(sql, sf_dir)
    assert columns == names
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not bad, (columns, bad[:3], len(bad))
