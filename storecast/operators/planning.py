"""K — planning operators described in the reference's text (tier 2)."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def safety_stock(vectors: DataFrame, z: float = 1.65, lead_time_weeks: float = 2.0,
                 sigma: str = "std_weekly") -> DataFrame:
    """K4 — Z x sigma x sqrt(lead time) per entity (store or cluster vector)."""
    return vectors.withColumn("safety_stock", F.lit(z) * F.col(sigma) * F.lit(math.sqrt(lead_time_weeks)))


def unemployment_trigger(df: DataFrame, key: str = "store", col: str = "unemployment",
                         rise_pp: float = 0.5) -> DataFrame:
    """K5 — quarterly mean per key and a flag when it rose by more than ``rise_pp`` points
    over the previous quarter (window per key: one row per quarter)."""
    q = (df.groupBy(key, F.year("week").alias("year"), F.quarter("week").alias("quarter"))
         .agg(F.avg(col).alias("q_mean")))
    w = Window.partitionBy(key).orderBy("year", "quarter")
    q = q.withColumn("prev", F.lag("q_mean").over(w))
    return q.withColumn("rise", F.col("q_mean") - F.col("prev")).withColumn(
        "trigger", F.when(F.col("rise") > rise_pp, 1).otherwise(0))


def nearest_centroid(entities: DataFrame, centroids: DataFrame, cols: Sequence[str], label: str,
                     same: str | None = None, out: str = "assigned", max_centroids: int = 10_000) -> DataFrame:
    """K6 — assign each entity to the nearest centroid (Euclidean on ``cols``), optionally only
    among centroids with the same ``same`` attribute.

    The centroid table (one row per cluster, bounded by the model's k
    and checked) becomes one literal array attached to every entity, so
    the assignment is an array expression, not a pairwise join.
    """
    rows = centroids.select(label, *cols, *([same] if same else [])).limit(max_centroids + 1).collect()
    if len(rows) > max_centroids:
        raise ValueError(f"more than {max_centroids} centroids")

    def lit_struct(r):
        parts = [F.lit(r[label]).alias("lab")] + [F.lit(float(r[c])).alias(c) for c in cols]
        if same:
            parts.append(F.lit(r[same]).alias("_same"))
        return F.struct(*parts)
    x = entities.withColumn("_cents", F.array(*[lit_struct(r) for r in rows]))

    def dist(c: Column) -> Column:
        return F.sqrt(sum((c[k] - F.col(k).cast("double")) ** 2 for k in cols))
    cands = F.col("_cents")
    if same:
        cands = F.filter(cands, lambda c: c["_same"] == F.col(same))
    best = F.array_min(F.transform(cands, lambda c: F.struct(dist(c).alias("d"), c["lab"].alias("lab"))))
    return x.withColumn(out, best["lab"]).withColumn(f"{out}_distance", best["d"]).drop("_cents")


def cold_start_profile(panel: DataFrame, stores: DataFrame, label: str = "type") -> DataFrame:
    """K6 — cluster-mean sales by ISO week for the assigned cluster (the new store's lag stand-in)."""
    prof = panel.join(stores.select("store", label), "store").groupBy(label, "week_of_year").agg(
        F.avg("weekly_sales").alias("cluster_mean_sales"))
    return prof


def retraining_window(df: DataFrame, months: int = 24, date_col: str = "week") -> DataFrame:
    """K7 — trailing ``months`` window ending at the latest date (the max date is a literal)."""
    mx = df.agg(F.max(date_col).alias("_mx")).first()["_mx"]
    return df.where(F.col(date_col) > F.add_months(F.lit(mx), -months))


def md5_bucket(*cols: str, buckets: int = 100) -> Column:
    """Stable bucket of the md5 of the key text (engine-independent, so SQL can reproduce it)."""
    txt = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def rolling_holdout(df: DataFrame, key: str = "store", period_col: str = "year", share: int = 20) -> DataFrame:
    """K8 — per period, a stable ``share`` % of keys is held out (md5 bucket of key and period)."""
    return df.withColumn("holdout", F.when(md5_bucket(key, period_col) < share, 1).otherwise(0))


def walk_forward(df: DataFrame, width: int = 52, horizon: int = 13, date_col: str = "week") -> DataFrame:
    """K9 — fixed-width walk-forward windows over the distinct dates: fold f trains on
    ``width`` dates and tests on the next ``horizon`` dates. Returns (date, fold, role).

    The date index is a window over distinct dates (one row per calendar date).
    """
    dates = df.select(date_col).distinct()
    dates = dates.withColumn("_i", F.row_number().over(Window.orderBy(date_col)) - 1)
    # a date can be in several folds: fold f covers [f*h, f*h + width + h)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - width - horizon + 1) / horizon))
    x = dates.withColumn("fold", F.explode(F.sequence(first.cast("int"), F.floor(F.col("_i") / horizon).cast("int"))))
    start = F.col("fold") * horizon
    role = F.when(F.col("_i") < start + width, "train").otherwise("test")
    x = x.where((F.col("_i") >= start) & (F.col("_i") < start + width + horizon))
    return x.select(date_col, "fold", role.alias("role"))


def hierarchy_totals(df: DataFrame, value: str = "weekly_sales") -> DataFrame:
    """K12 — Store x Dept, Store and Total levels in one ROLLUP aggregate, with the level name."""
    g = df.rollup("store", "dept").agg(F.sum(F.col(value).cast("decimal(20,2)")).cast("double").alias("total"),
                                       F.grouping_id().alias("_gid"))
    level = F.when(F.col("_gid") == 0, "store_dept").when(F.col("_gid") == 1, "store").otherwise("total")
    return g.select(level.alias("level"), "store", "dept", "total")


def hierarchy_consistency(totals: DataFrame) -> DataFrame:
    """K12 — bottom-up check: each store total minus the sum of its store-dept cells (should be 0)."""
    money = F.col("total").cast("decimal(20,2)")  # totals are whole cents: exact, order-free sums
    cells = totals.where(F.col("level") == "store_dept").groupBy("store").agg(F.sum(money).alias("_cells"))
    stores = totals.where(F.col("level") == "store").select("store", money.alias("_store"))
    return stores.join(cells, "store").select("store", (F.col("_store") - F.col("_cells")).cast("double").alias("gap"))


def drift_report(df: DataFrame, cols: Sequence[str], recent_from: str, bins: int = 10,
                 date_col: str = "week", eps: float = 1e-6) -> DataFrame:
    """K14 — per feature: mean shift and PSI between the reference period (< ``recent_from``) and
    the recent period, on equal-width bins taken from the reference period."""
    recent = F.col(date_col) >= F.lit(recent_from).cast("date")
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.select(recent.alias("_recent"), F.expr(f"stack({len(cols)}, {pairs}) AS (feature, value)"))
    long = long.where(F.col("value").isNotNull())
    edges = long.where(~F.col("_recent")).groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    x = long.join(F.broadcast(edges), "feature")
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width == 0, 0).otherwise(F.least(F.greatest(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(0)), F.lit(bins - 1)))
    x = x.withColumn("bin", b.cast("int"))
    cnt = x.groupBy("feature", "bin").agg(F.sum(F.when(~F.col("_recent"), 1).otherwise(0)).alias("_r"),
                                          F.sum(F.when(F.col("_recent"), 1).otherwise(0)).alias("_n"))
    tot = x.groupBy("feature").agg(F.sum(F.when(~F.col("_recent"), 1).otherwise(0)).alias("_rt"),
                                   F.sum(F.when(F.col("_recent"), 1).otherwise(0)).alias("_nt"),
                                   F.avg(F.when(~F.col("_recent"), F.col("value"))).alias("ref_mean"),
                                   F.avg(F.when(F.col("_recent"), F.col("value"))).alias("recent_mean"))
    p_ref = F.greatest(F.col("_r") / F.col("_rt"), F.lit(eps))
    p_new = F.greatest(F.col("_n") / F.col("_nt"), F.lit(eps))
    psi = cnt.join(tot, "feature").groupBy("feature", "ref_mean", "recent_mean").agg(
        F.sum((p_new - p_ref) * F.log(p_new / p_ref)).alias("psi"))
    return psi.withColumn("mean_shift", F.col("recent_mean") - F.col("ref_mean"))


def sample_weights(df: DataFrame, flag: str, weight: float = 0.2, out: str = "w") -> DataFrame:
    """K17 — down-weight flagged weeks before fitting (weight column for ``weightCol``)."""
    return df.withColumn(out, F.when(F.col(flag) == 1, F.lit(weight)).otherwise(F.lit(1.0)))


def fallback_prediction(full: Column, lag_only: Column) -> Column:
    """K16 — use the full model's prediction, else the lag-only model's when exogenous inputs are late."""
    return F.coalesce(full, lag_only)
