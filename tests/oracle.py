"""Compare a Spark result with DuckDB on the same files."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value).replace(" 00:00:00", "") if hasattr(value, "isoformat") else value
    return float(value)


def rows(records, columns, order) -> list[tuple]:
    place = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[k]) for k in place) for r in records), key=lambda r: repr(tuple(round(x, 4) if isinstance(x, float) else x for x in r)))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def assert_equal(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    found = con.sql(sql)
    order = sorted(df.columns)
    assert order == sorted(found.columns)
    ours, theirs = rows(df.collect(), df.columns, order), rows(found.fetchall(), found.columns, order)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(map(same, a, b)), (order, a, b)
    return len(ours)
