"""Registered queries: panel, wrangling, windows, split and the seasonal-naive slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from storecast.functions.scalar import rnd

from storecast.operators import features as fe
from storecast.operators import forecast as fc
from storecast.operators import windows
from storecast.plans import sql_blocks as S
from storecast.plans.registry import register
from storecast.sources import panel as P


def engineered(spark, sf_dir):
    return fe.engineer(P.wrangled_panel(spark, sf_dir), iqr=False)


def split(spark, sf_dir):
    return fe.temporal_split(fe.model_rows(engineered(spark, sf_dir)))


# ---- A4 panel -----------------------------------------------------------------

@register("a4_panel_sales", S.with_ctes([S.PANEL_SALES], "SELECT * FROM panel_sales"))
def a4_panel_sales(spark, sf_dir):
    return P.panel_sales(spark, sf_dir)


@register("a4_panel_features", S.with_ctes([S.PANEL_FEATURES], "SELECT * FROM panel_features"))
def a4_panel_features(spark, sf_dir):
    return P.panel_features(spark, sf_dir)


@register("a4_panel_stores", S.with_ctes([S.PANEL_STORES], "SELECT * FROM panel_stores"))
def a4_panel_stores(spark, sf_dir):
    return P.panel_stores(spark, sf_dir)


@register("c4_wrangled_panel", S.with_ctes(S.BASE, "SELECT * FROM panel"))
def c4_wrangled_panel(spark, sf_dir):
    """C1 fill, C2 ffill/bfill, C4/C5 joins, C8 total markdown, C9 calendar."""
    return P.wrangled_panel(spark, sf_dir)


# ---- W1/W2 windows ------------------------------------------------------------

@register("w1_w2_lags_rolls", S.with_ctes(S.BASE + [S.ENGINEERED], """
SELECT store, dept, week, lag_1, lag_4, lag_52, ROUND(roll_4, 4) AS roll_4, ROUND(roll_12, 4) AS roll_12
FROM eng"""))
def w1_w2_lags_rolls(spark, sf_dir):
    df = P.panel_sales(spark, sf_dir)
    df = windows.lags(df, "weekly_sales", (1, 4, 52))
    df = windows.rolling_means(df, "weekly_sales", (4, 12))
    return df.select("store", "dept", "week", "lag_1", "lag_4", "lag_52",
                     rnd("roll_4", 4).alias("roll_4"), rnd("roll_12", 4).alias("roll_12"))


@register("w1_calendar_lag", S.with_ctes([S.PANEL_SALES], """
SELECT a.store, a.dept, a.week, b.weekly_sales AS lag_52
FROM panel_sales a LEFT JOIN panel_sales b
  ON a.store = b.store AND a.dept = b.dept AND b.week = a.week - INTERVAL 364 DAY"""))
def w1_calendar_lag(spark, sf_dir):
    """W1 with ``calendar=True``: same week one year (52 x 7 days) back, NULL when absent."""
    df = P.panel_sales(spark, sf_dir).select("store", "dept", "week", "weekly_sales")
    return windows.lags(df, "weekly_sales", (52,), calendar=True).select("store", "dept", "week", "lag_52")


# ---- E6 split + K1 seasonal naive (the minimum end-to-end slice) ---------------

@register("e6_temporal_split", S.with_ctes(S.MODEL, """
SELECT c.cutoff_day,
       (SELECT COUNT(*) FROM train_rows) AS train_rows,
       (SELECT COUNT(*) FROM test_rows) AS test_rows,
       (SELECT MIN(week) FROM test_rows) AS first_test_week
FROM cutoff c"""))
def e6_temporal_split(spark, sf_dir):
    rows = fe.model_rows(engineered(spark, sf_dir))
    cut = F.lit(fe.split_cutoff(rows).first()["cutoff_day"]).cast("double")
    day = F.unix_date("week")
    return rows.agg(cut.alias("cutoff_day"),
                    F.sum(F.when(day <= cut, 1).otherwise(0)).cast("bigint").alias("train_rows"),
                    F.sum(F.when(day > cut, 1).otherwise(0)).cast("bigint").alias("test_rows"),
                    F.min(F.when(day > cut, F.col("week"))).alias("first_test_week"))


SEASONAL_NAIVE_BY_TYPE_SQL = S.with_ctes(S.MODEL, """
SELECT 'seasonal_naive' AS model, type, """ + S.metrics_sql("weekly_sales", "lag_52") + """
FROM test_rows GROUP BY type""")


@register("k1_k3_seasonal_naive_by_type", SEASONAL_NAIVE_BY_TYPE_SQL)
def k1_k3_seasonal_naive_by_type(spark, sf_dir):
    """Flagship: seasonal-naive forecast scored on the held-out 20 % per store type."""
    _, test = split(spark, sf_dir)
    preds = fc.seasonal_naive(test, keep=["type"])
    return fc.metrics(preds, ["model", "type"], digits=2)


@register("i8_seasonal_naive_metrics", S.with_ctes(S.MODEL, """
SELECT 'seasonal_naive' AS model, """ + S.metrics_sql("weekly_sales", "lag_52", digits=4) + """,
       ROUND(AVG(CASE WHEN abs(weekly_sales) > 0 THEN abs((weekly_sales - lag_52) / weekly_sales) END), 4) AS mape
FROM test_rows"""))
def i8_seasonal_naive_metrics(spark, sf_dir):
    """I8 + K2: WMAE/RMSE/MAE/R2/MAPE of the seasonal-naive baseline on the test split."""
    _, test = split(spark, sf_dir)
    return fc.metrics(fc.seasonal_naive(test), ["model"], digits=4, with_mape=True)


@register("i11_time_folds", S.with_ctes(S.MODEL + [
    "per_date AS (SELECT week, COUNT(*) AS rows FROM train_rows GROUP BY week)",
    """cum AS (SELECT week, rows,
        COALESCE(SUM(rows) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        SUM(rows) OVER () AS n FROM per_date)"""], """
SELECT week, rows,
       CAST(CASE WHEN before < n - 4 * floor(n / 5) THEN 0
                 ELSE least(floor((before - (n - 4 * floor(n / 5))) / floor(n / 5)) + 1, 4) END AS INTEGER) AS fold_test
FROM cum"""))
def i11_time_folds(spark, sf_dir):
    train, _ = split(spark, sf_dir)
    return fc.time_folds(train, k=4)


# ---- S1-S4, S8 engineered features and W6 ranks --------------------------------

@register("s1_s8_engineered_features", S.with_ctes(S.BASE, """
SELECT store, dept, week,
       CASE WHEN type = 'B' THEN 1 ELSE 0 END AS type_B, CASE WHEN type = 'C' THEN 1 ELSE 0 END AS type_C,
       ROUND(sin(2 * pi() * month / 12.0E0), 8) AS month_sin, ROUND(cos(2 * pi() * month / 12.0E0), 8) AS month_cos,
       ROUND(sin(2 * pi() * week_of_year / 52.0E0), 8) AS week_sin, ROUND(cos(2 * pi() * week_of_year / 52.0E0), 8) AS week_cos,
       CASE WHEN total_markdown > 0 THEN 1 ELSE 0 END AS has_markdown,
       CASE WHEN weekly_sales < 0 THEN 1 ELSE 0 END AS is_negative,
       ROUND(ln(1 + greatest(weekly_sales, 0)), 8) AS weekly_sales_log
FROM panel"""))
def s1_s8_engineered_features(spark, sf_dir):
    """One-hot type (drop first), cyclical month/week, markdown and negative flags, log1p target."""
    from storecast.functions import scalar
    df = engineered(spark, sf_dir).withColumn("is_negative", scalar.flag(F.col("weekly_sales") < 0))
    r8 = lambda c: rnd(c, 8).alias(c)
    return df.select("store", "dept", "week", "type_B", "type_C", r8("month_sin"), r8("month_cos"), r8("week_sin"),
                     r8("week_cos"), "has_markdown", "is_negative", r8("weekly_sales_log"))


@register("w6_average_ranks", S.with_ctes(S.BASE, """
SELECT weekly_sales, COUNT(*) AS ties, MIN(r) + (COUNT(*) - 1) / 2.0E0 AS rank
FROM (SELECT weekly_sales, rank() OVER (ORDER BY weekly_sales) AS r FROM panel) GROUP BY weekly_sales"""))
def w6_average_ranks(spark, sf_dir):
    """Average ranks of weekly sales over the pooled panel (ties share the mean position)."""
    from storecast.operators import order
    return order.average_ranks(P.wrangled_panel(spark, sf_dir), "weekly_sales").select("weekly_sales", "ties", "rank")
