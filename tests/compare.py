"""Compares a query with its DuckDB SQL as unordered rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    return [c[0] for c in got.description], [str(c[1]) for c in got.description], got.fetchall()


def differences(df, sf_dir: str, sql: str) -> str:
    """'' if names, row counts and values agree."""
    names, kinds, rows = oracle(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, rows)
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"
