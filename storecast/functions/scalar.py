"""S — scalar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cyclical(c: Column | str, period: float) -> tuple[Column, Column]:
    """S1 — (sin, cos) of ``2*pi*c/period``; week 53 wraps past 2*pi, as the reference."""
    angle = F.lit(2 * math.pi) * _c(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def add_cyclical(df: DataFrame) -> DataFrame:
    """S1 on month (12) and ISO week (52)."""
    ms, mc = cyclical("month", 12)
    ws, wc = cyclical("week_of_year", 52)
    return (df.withColumn("month_sin", ms).withColumn("month_cos", mc)
            .withColumn("week_sin", ws).withColumn("week_cos", wc))


def log1p_clipped(c: Column | str) -> Column:
    """S2 — ``log1p(clip(x, 0))``."""
    return F.log1p(F.greatest(_c(c), F.lit(0.0)))


def flag(cond: Column) -> Column:
    """S3/S8 — boolean condition as 0/1 int (NULL condition -> 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def one_hot_drop_first(df: DataFrame, col: str, levels: Sequence[str], prefix: str | None = None) -> DataFrame:
    """S4 — ``get_dummies(drop_first=True)``: the alphabetically first level gets no column.

    ``levels`` is the level list (a dimension's distinct values, e.g.
    from ``distinct_levels``); it is a schema decision, so the caller
    owns it rather than the operator collecting data.
    """
    prefix = prefix or col
    for lv in sorted(levels)[1:]:
        df = df.withColumn(f"{prefix}_{lv}", flag(F.col(col) == F.lit(lv)))
    return df


def distinct_levels(df: DataFrame, col: str, max_levels: int = 1000) -> list[str]:
    """Sorted distinct levels of a low-cardinality column; refuses more than ``max_levels``."""
    rows = df.select(col).distinct().orderBy(col).limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels")
    return [r[0] for r in rows if r[0] is not None]


def safe_max1(c: Column | str) -> Column:
    """S5 — ``max(x, 1)`` guard used for ratios."""
    return F.greatest(_c(c), F.lit(1.0))


def itemset_string(c: Column | str) -> Column:
    """S6 — ``', '.join(map(str, sorted itemset))``."""
    return F.array_join(F.transform(F.array_sort(_c(c)), lambda x: x.cast("string")), ", ")


def parse_day_first(c: Column | str) -> Column:
    """S7 — ``DD/MM/YYYY`` text to DATE."""
    return F.to_date(_c(c), "dd/MM/yyyy")


def rnd(c: Column | str, digits: int) -> Column:
    """Round half away from zero through DECIMAL, as SQL engines do for DECIMAL values.

    Rounding the double directly can tip an exact tie (e.g. 53124.6671875 to 6 places) either way
    depending on the last binary digit; going through DECIMAL(38, digits + 3) first makes the tie
    explicit, so every engine rounds it the same way.
    """
    return F.round(_c(c).cast(f"decimal(38,{digits + 3})"), digits).cast("double")
