"""Feature engineering on the wrangled panel."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storecast.functions import scalar
from storecast.operators import order, windows

STORE_TYPES = ("A", "B", "C")
LAG_COLS = ["lag_1", "lag_4", "lag_52", "roll_4", "roll_12"]
# Forecast feature list (24 columns, reference order).
FORECAST_FEATURES = [
    "store", "dept_id", "size", "temperature", "fuel_price", "cpi", "unemployment", "is_holiday",
    "total_markdown", "has_markdown", "year", "month", "week_of_year",
    "month_sin", "month_cos", "week_sin", "week_cos", "type_B", "type_C",
    "lag_1", "lag_4", "lag_52", "roll_4", "roll_12",
]


def iqr_fence(df: DataFrame, col: str = "weekly_sales", k: float = 1.5) -> DataFrame:
    """E5 — one row: q1, q3, iqr, lower, upper (exact linear quantiles)."""
    q = order.quantiles(df, col, [0.25, 0.75], names=["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", iqr.alias("iqr"), (F.col("q1") - k * iqr).alias("lower"),
                    (F.col("q3") + k * iqr).alias("upper"))


def iqr_flags(df: DataFrame, col: str = "weekly_sales") -> DataFrame:
    """E5/S3 — add ``is_outlier_iqr`` and ``is_negative``.

    The two fence values are computed once (one small job) and enter
    the plan as literals, so later stages filter without re-running the
    quantile sub-plan.
    """
    fence = iqr_fence(df, col).first()
    lower, upper = fence["lower"], fence["upper"]
    out_fl = (F.col(col) < F.lit(lower)) | (F.col(col) > F.lit(upper)) if lower is not None else F.lit(False)
    return (df.withColumn("is_outlier_iqr", scalar.flag(out_fl))
            .withColumn("is_negative", scalar.flag(F.col(col) < 0)))


def dept_codes(df: DataFrame, col: str = "dept") -> DataFrame:
    """Integer code per department (dense rank of the name) for numeric model features.

    Departments are a dimension (tens to hundreds of values), so the
    code table is aggregated and joined back, never collected.
    """
    codes = df.select(col).distinct()
    codes = codes.withColumn("dept_id", F.dense_rank().over(Window.orderBy(col)))
    return df.join(codes, col, "left")


def engineer(panel: DataFrame, iqr: bool = True) -> DataFrame:
    """Engineered panel: one-hot type, IQR/negative flags, lags, rolls, cyclical, markdown flag, log target."""
    df = scalar.one_hot_drop_first(panel, "type", STORE_TYPES)
    if iqr:
        df = iqr_flags(df)
    df = windows.lags(df, "weekly_sales", (1, 4, 52))
    df = windows.rolling_means(df, "weekly_sales", (4, 12))
    df = scalar.add_cyclical(df)
    df = df.withColumn("has_markdown", scalar.flag(F.col("total_markdown") > 0))
    return df.withColumn("weekly_sales_log", scalar.log1p_clipped("weekly_sales"))


def model_rows(df: DataFrame) -> DataFrame:
    """Rows where every lag/roll exists (``dropna(subset=...)``)."""
    return df.dropna(subset=LAG_COLS)


def split_cutoff(df: DataFrame, date_col: str = "week", frac: float = 0.8) -> DataFrame:
    """E6 — one row ``cutoff_day``: the ``frac`` quantile of the date over rows (days since epoch,
    linear interpolation, may fall between weeks)."""
    # a date has one count per calendar day or week: the exact quantile needs only those few rows
    per_date = df.where(F.col(date_col).isNotNull()).groupBy(F.unix_date(F.col(date_col)).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    counts = sorted((r["d"], r["n"]) for r in per_date.collect())
    h = (sum(n for _, n in counts) - 1) * frac

    def at(position: int) -> float:
        for d, n in counts:
            position -= n
            if position < 0:
                return float(d)
    lo = at(math.floor(h)) if counts else None
    cut = None if lo is None else lo + (h - math.floor(h)) * (at(math.ceil(h)) - lo)
    return df.sparkSession.createDataFrame([(cut,)], "cutoff_day double")


def temporal_split(df: DataFrame, date_col: str = "week", frac: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """E6 — (train, test) with train <= cutoff < test.

    The cutoff is one number computed by a small distributed job; it
    enters both plans as a literal condition on the date.
    """
    cut = split_cutoff(df, date_col, frac).first()["cutoff_day"]
    day = F.unix_date(F.col(date_col)).cast("double")
    if cut is None:
        return df, df.limit(0)
    return df.where(day <= F.lit(float(cut))), df.where(day > F.lit(float(cut)))


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """E7 — ``(x - mean) / std`` with the population std (ddof 0), as scikit-learn's scaler.

    The moments are one aggregate row that enters the plan as literals.
    A zero std maps to 1 (scikit-learn leaves such columns centred only).
    """
    if not cols:
        return df
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")]
    mom = df.agg(*aggs).first()  # 2 x len(cols) numbers, used as literals below
    x = df
    for c in cols:
        m, s = mom[f"_m_{c}"], mom[f"_s_{c}"]
        s = 1.0 if not s else s
        x = x.withColumn(c + suffix, (F.col(c) - F.lit(m)) / F.lit(float(s)))
    return x
