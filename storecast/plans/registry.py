"""Query registry: name -> (Spark builder, optional DuckDB oracle SQL)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def positive_zero_rounds(sql: str) -> str:
    """Make every ``ROUND(x, d)`` round through DECIMAL and return +0.0 for zero.

    ``ROUND(x, d)`` becomes ``CAST(ROUND(CAST(x AS DECIMAL(38, d + 3)), d) AS DOUBLE) + 0.0E0``,
    matching ``storecast.functions.scalar.rnd`` on the Spark side (ties are explicit decimals
    and round away from zero in both engines).

    DuckDB keeps the sign of a value that rounds to zero (``ROUND(-1e-9, 6)`` is -0.0) while
    Spark's ``round`` returns +0.0; adding +0.0 turns -0.0 into +0.0 and leaves every other
    value unchanged, so both engines print the same zero.
    """
    out, i, key = [], 0, "ROUND("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = positive_zero_rounds(sql[j + len(key):k])
        arg, _, digits = inner.rpartition(",")
        digits = digits.strip()
        if digits.isdigit() and "AS DECIMAL" not in arg:
            # round ties through DECIMAL like the Spark side (storecast.functions.scalar.rnd)
            out.append(sql[i:j] + f"(CAST(ROUND(CAST({arg} AS DECIMAL(38,{int(digits) + 3})), {digits}) AS DOUBLE) + 0.0E0)")
        else:
            out.append(sql[i:j] + "(ROUND(" + inner + ") + 0.0E0)")
        i = k + 1


def register(name: str, sql: str | None = None):
    """Register a Spark query; ``sql`` is its DuckDB equivalent (None = no SQL oracle)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = positive_zero_rounds(sql)
        return fn
    return deco
