"""Compares a query with its SQL in DuckDB, as sets of rows with columns by name."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ").replace("+00:00", "") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return float(v) if v.as_tuple().exponent < 0 else int(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b, (a, b)
