"""Compares a query with its SQL twin on one set of tables."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (int, decimal.Decimal)):
        return f"{float(v):.10g}"
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(norm(r[k]) for k in order) for r in records)


def same(df, sql: str, con) -> None:
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, found.fetchall())
    assert len(got) == len(want), (len(got), len(want))
    differ = [(g, w) for g, w in zip(got, want) if g != w]
    assert not differ, differ[:3]
