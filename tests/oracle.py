"""Comparing a query's rows with DuckDB's."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files!r})")
    return db


def plain(x):
    """A value as both engines show it."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def rows_of(names: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs between a DataFrame and a query of DuckDB; empty if nothing does."""
    db = connect(sf_dir)
    cursor = db.execute(sql)
    names, rows = [c[0] for c in cursor.description], cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)}, expected {sorted(names)}"]
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, rows)
    if len(got) != len(want):
        return [f"{len(got)} rows, expected {len(want)}"]
    return [f"{a} != {b}" for a, b in zip(got, want, strict=True) if a != b][:3]
