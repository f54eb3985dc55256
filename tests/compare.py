"""Spark results against DuckDB on the same tables."""

from __future__ import annotations

import math
import os


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        if isinstance(x, (bytes, bytearray)):
            return bytes(x).hex()
        return x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    out = c.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def same(df, sf_dir: str, sql: str) -> None:
    columns, expected = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(columns, expected)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)
