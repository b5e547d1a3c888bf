"""Registered queries for the CSV connectors (A1, A5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storecast.plans import sql_blocks as S
from storecast.plans.registry import register
from storecast.session import ensure_checkpoint_dir
from storecast.sources import csv as A
from storecast.sources import panel as P


@register("a1_a5_csv_roundtrip", S.with_ctes([S.PANEL_SALES], """
SELECT store, dept, week, weekly_sales, is_holiday FROM panel_sales"""))
def a1_a5_csv_roundtrip(spark, sf_dir):
    """Write the sales panel in the reference CSV layout (day-first dates) and scan it back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/sales-{uuid.uuid4().hex[:12]}"
    A.write_table(A.to_reference_layout(P.panel_sales(spark, sf_dir)), path)
    return A.to_panel_names(A.read_sales(spark, path)).select("store", "dept", "week", "weekly_sales", "is_holiday")


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{name}-{uuid.uuid4().hex[:12]}"


@register("a2_features_csv_roundtrip", S.with_ctes([S.PANEL_FEATURES], """
SELECT store, week, temperature, fuel_price, markdown1, markdown2, markdown3, markdown4, markdown5, cpi, unemployment,
       CASE WHEN weekofyear(week) IN (6, 36, 47, 52) THEN 1 ELSE 0 END AS is_holiday
FROM panel_features"""))
def a2_features_csv_roundtrip(spark, sf_dir):
    """Features in the reference CSV layout with NA for missing values, scanned back."""
    path = _scratch(spark, "features")
    A.write_table(A.features_reference_layout(P.panel_features(spark, sf_dir)), path)
    return A.to_panel_names(A.read_features(spark, path))


@register("a3_stores_csv_roundtrip", S.with_ctes([S.PANEL_STORES], "SELECT store, type, size FROM panel_stores"))
def a3_stores_csv_roundtrip(spark, sf_dir):
    path = _scratch(spark, "stores")
    A.write_table(A.stores_reference_layout(P.panel_stores(spark, sf_dir)), path, single_file=True)
    return A.to_panel_names(A.read_stores(spark, path))


@register("a5_a6_report_csv")
def a5_a6_report_csv(spark, sf_dir):
    """The whole leaderboard (model name as index column) and top-15 rules written as CSV reports and read back."""
    from storecast.operators import basket as J
    from storecast.plans.basket_queries import order_itemsets
    from storecast.plans.forecast_queries import i1_i9_leaderboard
    board = i1_i9_leaderboard(spark, sf_dir)
    rules = J.top_rules(J.association_rules(order_itemsets(spark, sf_dir)), 15)
    p1, p2 = _scratch(spark, "leaderboard"), _scratch(spark, "rules")
    A.write_table(board, p1, index_col="model", single_file=True)
    A.write_table(rules, p2, single_file=True)
    b = spark.read.option("header", True).option("inferSchema", False).csv(p1)
    r = spark.read.option("header", True).csv(p2)
    return b.select(F.lit("leaderboard").alias("report"), F.col("model").alias("key"), F.col("wmae").alias("value")).unionByName(
        r.select(F.lit("rules").alias("report"), F.concat_ws(" -> ", "antecedents_str", "consequents_str").alias("key"),
                 F.col("lift").alias("value")))
