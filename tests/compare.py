"""Spark rows against DuckDB rows: same columns, same multiset of values."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canon(x) for x in value)
    return value


def duck_rows(directory: str, sql: str):
    con = duckdb.connect()
    for path in Path(directory).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def assert_same(df, directory: str, sql: str) -> int:
    """Compare and return the number of rows."""
    names, expected = duck_rows(directory, sql)
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    want = Counter(tuple(canon(row[i]) for i in order) for row in expected)
    got = Counter(tuple(canon(v) for v in row) for row in df.collect())
    extra, missing = got - want, want - got
    assert not extra and not missing, f"extra {list(extra.items())[:3]}, missing {list(missing.items())[:3]}"
    return len(expected)
