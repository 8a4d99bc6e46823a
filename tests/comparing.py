"""Compares a query's rows with its DuckDB SQL's, by column name and without order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, decimal.Decimal):
        return format(x.normalize(), "f")
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(value(r[i]) for i in order) for r in found)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    return rows([d[0] for d in got.description], got.fetchall())


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if both have the same rows."""
    a, b = rows(df.columns, df.collect()), oracle(sql, sf_dir)
    if a == b:
        return ""
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    return f"{a[1].total()} and {b[1].total()} rows; only here {list((a[1] - b[1]).items())[:3]}; only there {list((b[1] - a[1]).items())[:3]}"
