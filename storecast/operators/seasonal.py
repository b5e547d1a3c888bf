"""I7 — per-series seasonal ARIMA-type forecaster, re-aimed as a job over every series.

The reference fits SARIMAX(1,1,1)(1,1,1,52) with exogenous inputs on one
series by exact maximum likelihood. Here every (store, dept) series is
one grouped-map task (a series holds at most one row per week): the
series is regularised to the weekly grid, differenced at lags 1 and 52,
and fitted by two-stage least squares (Hannan & Rissanen, 1982): a long
autoregression estimates the innovations, then the differenced series
is regressed on its lags 1, 52, 53, the lagged innovations and the
differenced exogenous inputs. Forecasts are recursive over the test
horizon and integrated back. A short series uses fewer lags (see ``_PLANS``);
``status`` names the plan, or why there is no forecast.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.functions.metrics import HOLIDAY_WEIGHT
from storecast.operators import windows
from storecast.operators.wrangle import ffill_bfill

EXOG = ["temperature", "fuel_price", "cpi", "unemployment", "is_holiday", "total_markdown"]


def _ols(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0]


#: From long to short series: (status, seasonal lags in the long autoregression, lags of the second stage).
_PLANS = [
    ("full", True, lambda s: [1, s, s + 1]),
    ("seasonal lag", False, lambda s: [1, s]),
    ("one lag", False, lambda s: [1]),
]


def _plan(n: int, split: int, s: int, n_exog: int):
    """The first plan for which both stages have enough training rows."""
    for status, seasonal, lags_of in _PLANS:
        long_lags, lags = list(range(1, 9)) + (list(range(s, s + 9)) if seasonal else []), lags_of(s)
        start1 = s + 1 + max(long_lags)
        start2 = start1 + max(lags)
        if split - start1 >= 3 * (len(long_lags) + n_exog) and split - start2 >= 2 * (2 * len(lags) + n_exog):
            return status, long_lags, lags, start1, start2
    raise ValueError(f"short: {n} weeks")


def _fit_forecast(y: np.ndarray, ex: np.ndarray, split: int, s: int) -> tuple[np.ndarray, str]:
    """Predictions for positions split..n-1 and the plan's name."""
    n = len(y)
    status, long_lags, lags, start1, start2 = _plan(n, split, s, ex.shape[1])
    w = np.full(n, np.nan)
    w[s + 1:] = y[s + 1:] - y[s:-1] - y[1:n - s] + y[:n - s - 1]
    dx = np.full_like(ex, np.nan)
    dx[s + 1:] = ex[s + 1:] - ex[s:-1] - ex[1:n - s] + ex[:n - s - 1]
    # stage 1: long autoregression on the training part -> innovation estimates
    rows = np.arange(start1, split)
    a1 = np.column_stack([w[rows - l] for l in long_lags] + [dx[rows], np.ones(len(rows))])
    b1 = _ols(a1, w[rows])
    e = np.zeros(n)
    e[rows] = w[rows] - a1 @ b1
    # stage 2: regression on lagged values and lagged innovations
    rows2 = np.arange(start2, split)

    def design(t_idx, wv, ev):
        return np.column_stack([wv[t_idx - l] for l in lags] + [ev[t_idx - l] for l in lags]
                               + [dx[t_idx], np.ones(len(t_idx))])
    b2 = _ols(design(rows2, w, e), w[rows2])
    yh = y.copy()
    wh = w.copy()
    eh = e.copy()
    eh[split:] = 0.0
    for t in range(split, n):
        wt = design(np.array([t]), wh, eh) @ b2
        wh[t] = wt[0]
        yh[t] = wh[t] + yh[t - 1] + yh[t - s] - yh[t - s - 1]
    return yh[split:], status


def forecast_series(panel: DataFrame, by: Sequence[str] = ("store", "dept"), value: str = "weekly_sales",
                    exog: Sequence[str] = EXOG, period: int = 52, train_frac: float = 0.8) -> DataFrame:
    """Per series: (by..., n_train, n_test, wmae, rmse, mae, r2, status) of the held-out last 20 % of grid weeks."""
    by, exog = list(by), list(exog)
    base = panel.select(*by, "week", value, *[F.col(c).cast("double").alias(c) for c in exog])
    grid = windows.weekly_grid(base, by)
    grid = windows.interpolate_linear(grid.withColumn("_obs", F.col(value)), value, by, out="_y")
    grid = ffill_bfill(grid, exog, by, "week")
    fields = [panel.schema[c] for c in by] + [
        T.StructField("n_train", T.IntegerType()), T.StructField("n_test", T.IntegerType()),
        T.StructField("wmae", T.DoubleType()), T.StructField("rmse", T.DoubleType()),
        T.StructField("mae", T.DoubleType()), T.StructField("r2", T.DoubleType()),
        T.StructField("status", T.StringType())]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        key = {c: pdf[c].iloc[0] for c in by}
        n = len(pdf)
        split = int(n * train_frac)
        out = dict(key, n_train=split, n_test=n - split, wmae=None, rmse=None, mae=None, r2=None, status=None)
        try:
            y = pdf["_y"].to_numpy(float)
            first = int(np.argmax(~np.isnan(y)))
            if first:
                y[:first] = y[first]
            ex = np.nan_to_num(pdf[exog].to_numpy(float))
            pred, out["status"] = _fit_forecast(y, ex, split, period)
            obs = pdf["_obs"].to_numpy(float)[split:]
            hol = pdf["is_holiday"].to_numpy(float)[split:]
            m = ~np.isnan(obs) & np.isfinite(pred)
            if m.sum() == 0:
                raise ValueError("no observed test weeks")
            err = obs[m] - pred[m]
            wgt = np.where(hol[m] > 0, HOLIDAY_WEIGHT, 1.0)
            sst = ((obs[m] - obs[m].mean()) ** 2).sum()
            out.update(wmae=float((wgt * np.abs(err)).sum() / wgt.sum()), rmse=float(np.sqrt((err ** 2).mean())),
                       mae=float(np.abs(err).mean()), r2=float(1 - (err ** 2).sum() / sst) if sst > 0 else None)
        except (ValueError, np.linalg.LinAlgError) as e:  # the reference reports NaN metrics when the fit fails
            out["status"] = str(e)
        return pd.DataFrame([out])

    return grid.select(*by, "week", "_y", "_obs", *exog).groupBy(*by).applyInPandas(run, T.StructType(fields))
