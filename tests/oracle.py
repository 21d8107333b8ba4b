"""Comparing a query's rows with those that DuckDB gives for its SQL."""

import math
from pathlib import Path

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else repr(float(r[i])) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in found))


def same(df, sql: str, folder: str) -> None:
    con = duck(folder)
    cursor = con.execute(sql)
    names, expected = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, expected)
