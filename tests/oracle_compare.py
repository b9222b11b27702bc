"""Run a registered Spark query and its DuckDB oracle side by side and compare.

Comparison mirrors the driver: columns sorted by name, row count, and an
order-insensitive multiset of rows.  Doubles are compared exactly and, separately,
after rounding to 9 significant digits (reported as ``close``).
"""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v, digits: int | None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if digits is None:
            return v
        return float(f"{v:.{digits}g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _canon(v.item(), digits)
    return v


def rows_of(cols: list[str], rows, digits: int | None) -> Counter:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_canon(r[i], digits) for i in order) for r in rows)


def compare(spark, con, key: str, fn, sql: str | None, sf_dir: str) -> dict:
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    out = {"key": key, "spark_rows": len(s_rows)}
    if sql is None:
        out["status"] = "no-oracle"
        return out
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out["oracle_rows"] = len(d_rows)
    out["schema"] = sorted(s_cols) == sorted(d_cols)
    exact = rows_of(s_cols, s_rows, None) == rows_of(d_cols, d_rows, None)
    close = rows_of(s_cols, s_rows, 9) == rows_of(d_cols, d_rows, 9)
    out["exact"] = exact
    out["close"] = close
    out["status"] = "ok" if (out["schema"] and exact) else ("close" if out["schema"] and close else "FAIL")
    if out["status"] == "FAIL":
        a, b = rows_of(s_cols, s_rows, 9), rows_of(d_cols, d_rows, 9)
        out["spark_only"] = list((a - b).items())[:3]
        out["oracle_only"] = list((b - a).items())[:3]
        out["cols"] = (s_cols, d_cols)
    return out
