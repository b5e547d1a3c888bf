"""Run a registered Spark query and its DuckDB oracle on the same parquet tables and compare."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

from storecast.sources.tables import TABLE_NAMES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int = 9):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == 0:
            return "-0.0" if math.copysign(1.0, v) < 0 else 0.0  # a signed zero is a different value
        return float(f"{v:.{digits}g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)) if x is not None else "", x if x is not None else 0) for x in row)


def compare(spark, con, name: str, spark_fn, sql: str, sf_dir: str, digits: int = 17):
    """Return (ok, message)."""
    sdf = spark_fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    s_norm = sorted((tuple(_norm(r[i], digits) for i in si) for r in s_rows), key=_key)
    d_norm = sorted((tuple(_norm(r[i], digits) for i in di) for r in d_rows), key=_key)
    if len(s_norm) != len(d_norm):
        return False, f"rows differ: spark={len(s_norm)} duck={len(d_norm)}"
    for a, b in zip(s_norm, d_norm):
        if a != b:
            return False, f"first differing row:\n spark={dict(zip(order, a))}\n duck ={dict(zip(order, b))}"
    return True, f"{len(s_norm)} rows"
