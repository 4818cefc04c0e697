"""A query's rows against DuckDB's for the same tables: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(value):
    """Values that compare alike whichever engine made them."""
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value) if isinstance(value, datetime.date) else value


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(map(plain, r)) for r in df.select(*names).collect())


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both sides have the same columns and rows; else what differs first."""
    (a, left), (b, right) = spark_rows(df), oracle_rows(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    if left == right:
        return ""
    return f"{sum((left - right).values())} rows only here, as {list((left - right).items())[:2]}; {sum((right - left).values())} only there, as {list((right - left).items())[:2]}; columns {a}"
