"""W — per-series window features.

Every window here is partitioned by a series key (store, dept). The
panel is unique on (series, week), so one partition holds at most one
row per calendar week however skewed the raw facts are. All lags and
rolls share one partitioning and one sort, so Spark plans a single
exchange for the whole feature block.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("store", "dept")


def lags(df: DataFrame, col: str, ks: Sequence[int] = (1, 4, 52), by: Sequence[str] = SERIES,
         order: str = "week", prefix: str = "lag_", calendar: bool = False) -> DataFrame:
    """W1 — ``shift(k)`` within each series (row offset, as the reference).

    ``calendar=True`` instead takes the value exactly ``7k`` days earlier
    (a keyed self-join, so a missing week yields NULL, not an older row).
    """
    if calendar:
        out = df
        for k in ks:
            prev = df.select(*by, F.date_add(F.col(order), 7 * k).alias(order),
                             F.col(col).alias(f"{prefix}{k}"))
            out = out.join(prev, [*by, order], "left")
        return out
    w = Window.partitionBy(*by).orderBy(order)
    for k in ks:
        df = df.withColumn(f"{prefix}{k}", F.lag(col, k).over(w))
    return df


def rolling_means(df: DataFrame, col: str, ws: Sequence[int] = (4, 12), by: Sequence[str] = SERIES,
                  order: str = "week", prefix: str = "roll_") -> DataFrame:
    """W2 — mean of the previous ``w`` rows (``shift(1).rolling(w).mean()``), NULL unless all ``w`` exist."""
    for w in ws:
        frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-w, -1)
        df = df.withColumn(f"{prefix}{w}", F.when(F.count(col).over(frame) == w, F.avg(col).over(frame)))
    return df


def weekly_grid(df: DataFrame, by: Sequence[str] = SERIES, date_col: str = "week",
                step_days: int = 7) -> DataFrame:
    """W5 — regular grid from each series' first to last date (``asfreq``); gaps come back as NULL rows.

    The grid per series is bounded by its date span / step; the explode
    runs in the task that holds that series' (min, max) row.
    """
    bounds = df.groupBy(*by).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    grid = bounds.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step_days} DAYS"))).alias(date_col))
    return grid.join(df, [*by, date_col], "left")


def interpolate_linear(df: DataFrame, col: str, by: Sequence[str] = SERIES, order: str = "week",
                       out: str | None = None) -> DataFrame:
    """W4 — pandas ``interpolate()`` on a regular grid.

    Interior gaps are blended linearly by row position, trailing gaps
    carry the last value forward, leading gaps stay NULL.
    """
    out = out or col
    w = Window.partitionBy(*by).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    pos = F.row_number().over(w)
    df = df.withColumn("_rp", pos)
    known_pos = F.when(F.col(col).isNotNull(), F.col("_rp"))
    df = (df.withColumn("_pv", F.last(col, ignorenulls=True).over(past))
            .withColumn("_pp", F.last(known_pos, ignorenulls=True).over(past))
            .withColumn("_nv", F.first(col, ignorenulls=True).over(future))
            .withColumn("_np", F.first(known_pos, ignorenulls=True).over(future)))
    frac = (F.col("_rp") - F.col("_pp")) / (F.col("_np") - F.col("_pp"))
    val = (F.when(F.col(col).isNotNull(), F.col(col))
           .when(F.col("_pv").isNull(), F.lit(None))
           .when(F.col("_nv").isNull(), F.col("_pv"))
           .otherwise(F.col("_pv") + frac * (F.col("_nv") - F.col("_pv"))))
    return df.withColumn(out, val).drop("_rp", "_pv", "_pp", "_nv", "_np")
