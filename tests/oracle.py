"""Compare a query with DuckDB SQL over the same tables."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same(df, db, sql):
    """Row sets and column names agree; reals to nine places."""
    made = db.sql(sql)
    columns, rows = made.columns, made.fetchall()
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    norm = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    key = lambda t: tuple((v is None, str(type(v)), 0 if v is None else v) for v in t)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(norm(dict(zip(columns, r, strict=True))[c]) for c in order) for r in rows), key=key)
    assert got == want
