"""Comparison of a Spark result with a DuckDB one, as multisets of rows."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal


def plain(v):
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return v


def rows_of(df) -> Counter:
    columns = sorted(df.columns)
    return Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(repr([plain(r[i]) for i in order]) for r in cursor.fetchall())
