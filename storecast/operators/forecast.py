"""I / K1-K3 — forecasting jobs: baselines, metrics, leaderboard, folds, model fits."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storecast.functions.scalar import rnd

from storecast.functions.metrics import metric_aggs, mape_agg


def predictions(df: DataFrame, model: str, yhat: str, y: str = "weekly_sales",
                holiday: str = "is_holiday", keep: Sequence[str] = ()) -> DataFrame:
    """Long form (model, y, yhat, is_holiday, keep...) used by every metric operator."""
    return df.select(F.lit(model).alias("model"), *keep, F.col(y).cast("double").alias("y"),
                     F.col(yhat).cast("double").alias("yhat"), F.col(holiday).alias("is_holiday"))


def seasonal_naive(test: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """K1 — predict this week by the same series 52 rows back (``lag_52``)."""
    return predictions(test, "seasonal_naive", "lag_52", keep=keep)


def metrics(preds: DataFrame, by: Sequence[str] = (), digits: int | None = None,
            with_mape: bool = False) -> DataFrame:
    """I8/K2/K3 — WMAE, RMSE, MAE, R2 (and MAPE) per ``by`` group in one aggregate."""
    aggs = metric_aggs() + ([mape_agg()] if with_mape else [])
    out = preds.groupBy(*by).agg(*aggs)
    if digits is not None:
        for c in ["wmae", "rmse", "mae", "r2"] + (["mape"] if with_mape else []):
            out = out.withColumn(c, rnd(c, digits))
    return out


def leaderboard(preds: Iterable[DataFrame], digits: int = 2) -> DataFrame:
    """I9 — stack each model's predictions and score them with one grouped aggregate."""
    preds = list(preds)
    stacked = preds[0]
    for p in preds[1:]:
        stacked = stacked.unionByName(p)
    return metrics(stacked, ["model"], digits)


def best_model(board: DataFrame, metric: str = "wmae") -> DataFrame:
    """I12 — argmin of the (rounded) metric, first model name on ties."""
    return board.orderBy(F.col(metric).asc(), F.col("model").asc()).limit(1)


def time_folds(df: DataFrame, k: int = 4, date_col: str = "week") -> DataFrame:
    """I11 — expanding time-ordered folds over dates (``TimeSeriesSplit`` on the time axis).

    Rows are ordered by date; with n rows the test blocks are the last
    ``k`` blocks of ``n // (k + 1)`` rows and each fold trains on all
    earlier rows. A date is never split: a date belongs to the block
    that holds its first row. Returns (date, fold_test) where fold_test
    in 1..k marks the fold whose test block holds that date, 0 = only
    ever training. The running count is a window over the per-date
    count table (one row per calendar date, not per fact row).
    """
    per_date = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, -1)
    per_date = per_date.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    n = per_date.agg(F.sum("_c").alias("_n")).first()["_n"] or 0
    x = per_date
    size = F.floor(F.lit(n) / F.lit(k + 1))
    first_test = F.lit(n) - F.lit(k) * size
    fold = F.when(F.col("_before") < first_test, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_before") - first_test) / size) + 1, F.lit(k)))
    return x.select(date_col, F.col("_c").alias("rows"), fold.cast("int").alias("fold_test"))


def markdown_sensitivity(df: DataFrame, by: Sequence[str] = ("store",)) -> DataFrame:
    """K10 — per group: slope of sales on total markdown and the active/inactive mean ratio."""
    act = F.col("total_markdown") > 0
    return df.groupBy(*by).agg(
        F.regr_slope("weekly_sales", "total_markdown").alias("md_slope"),
        F.try_divide(F.avg(F.when(act, F.col("weekly_sales"))), F.avg(F.when(~act, F.col("weekly_sales")))).alias("md_ratio"),
    )
