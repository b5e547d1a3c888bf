"""Registered queries for the planning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from storecast.functions.scalar import rnd

from storecast.operators import features as fe
from storecast.operators import forecast as fc
from storecast.operators import models as M
from storecast.operators import order
from storecast.operators import planning as K
from storecast.operators import segment as H
from storecast.plans.anomaly_queries import g5_stl_anomalies
from storecast.plans.explore_queries import panel, q
from storecast.plans.registry import register
from storecast.plans.segment_queries import _H1, COLS, _materialized, h3_kmeans_labels, store_vectors
from storecast.sources import panel as P


@register("k4_safety_stock", q(",\n" + _H1 + """
SELECT store, ROUND(1.65 * std_weekly * sqrt(2.0E0), 4) AS safety_stock FROM sf"""))
def k4_safety_stock(spark, sf_dir):
    v = K.safety_stock(store_vectors(spark, sf_dir), 1.65, 2.0)
    return v.select("store", rnd("safety_stock", 4).alias("safety_stock"))


@register("k5_unemployment_trigger", q("""
, qm AS (SELECT store, CAST(year(week) AS INTEGER) AS year, CAST(quarter(week) AS INTEGER) AS quarter, AVG(unemployment) AS q_mean
         FROM panel GROUP BY 1, 2, 3),
l AS (SELECT *, lag(q_mean) OVER (PARTITION BY store ORDER BY year, quarter) AS prev FROM qm)
SELECT store, year, quarter, ROUND(q_mean, 6) AS q_mean, ROUND(q_mean - prev, 6) AS rise,
       CASE WHEN q_mean - prev > 0.5 THEN 1 ELSE 0 END AS trigger FROM l"""))
def k5_unemployment_trigger(spark, sf_dir):
    t = K.unemployment_trigger(panel(spark, sf_dir))
    return t.select("store", "year", "quarter", rnd("q_mean", 6).alias("q_mean"),
                    rnd("rise", 6).alias("rise"), "trigger")


@register("k6_cold_start_assignment", q(",\n" + _H1 + """,
c AS (SELECT type AS lab, AVG(size) AS c_size FROM sf GROUP BY type),
d AS (SELECT sf.store, c.lab, abs(c.c_size - sf.size) AS dist,
             row_number() OVER (PARTITION BY sf.store ORDER BY abs(c.c_size - sf.size), c.lab) AS rn FROM sf, c)
SELECT store, lab AS assigned, ROUND(dist, 6) AS assigned_distance FROM d WHERE rn = 1"""))
def k6_cold_start_assignment(spark, sf_dir):
    """Treat each store as new: nearest store-type centroid by size."""
    v = store_vectors(spark, sf_dir)
    cents = v.groupBy("type").agg(F.avg("size").alias("size"))
    a = K.nearest_centroid(v, cents, ["size"], "type")
    return a.select("store", "assigned", rnd("assigned_distance", 6).alias("assigned_distance"))


@register("k6_cold_start_profile", q("""
SELECT type, week_of_year, ROUND(AVG(weekly_sales), 6) AS cluster_mean_sales FROM panel GROUP BY type, week_of_year"""))
def k6_cold_start_profile(spark, sf_dir):
    p = panel(spark, sf_dir)
    prof = K.cold_start_profile(p, P.panel_stores(spark, sf_dir).select("store", F.col("type").alias("label")), "label")
    return prof.select(F.col("label").alias("type"), "week_of_year",
                       rnd("cluster_mean_sales", 6).alias("cluster_mean_sales"))


@register("k7_retraining_window", q("""
, mx AS (SELECT MAX(week) AS m FROM panel)
SELECT store, COUNT(*) AS rows, ROUND(SUM(weekly_sales), 4) AS sales FROM panel, mx
WHERE week > m - INTERVAL 24 MONTH GROUP BY store"""))
def k7_retraining_window(spark, sf_dir):
    w = K.retraining_window(panel(spark, sf_dir), 24)
    return w.groupBy("store").agg(F.count(F.lit(1)).alias("rows"), rnd(F.sum("weekly_sales"), 4).alias("sales"))


@register("k8_rolling_holdout", q("""
, sy AS (SELECT DISTINCT store, year FROM panel)
SELECT store, year, CASE WHEN CAST('0x' || substr(md5(CAST(store AS VARCHAR) || '|' || CAST(year AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20
                         THEN 1 ELSE 0 END AS holdout FROM sy"""))
def k8_rolling_holdout(spark, sf_dir):
    sy = panel(spark, sf_dir).select("store", "year").distinct()
    return K.rolling_holdout(sy, "store", "year", 20)


@register("k9_walk_forward", q("""
, d AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS i FROM (SELECT DISTINCT week FROM panel)),
f AS (SELECT week, i, unnest(generate_series(CAST(greatest(0, ceil((i - 52 - 13 + 1) / 13.0E0)) AS BIGINT),
                                             CAST(floor(i / 13.0E0) AS BIGINT))) AS fold FROM d)
SELECT week, CAST(fold AS INTEGER) AS fold, CASE WHEN i < fold * 13 + 52 THEN 'train' ELSE 'test' END AS role
FROM f WHERE i >= fold * 13 AND i < fold * 13 + 52 + 13"""))
def k9_walk_forward(spark, sf_dir):
    return K.walk_forward(panel(spark, sf_dir), 52, 13)


@register("k10_markdown_sensitivity", q("""
SELECT store, ROUND(regr_slope(weekly_sales, total_markdown), 6) AS md_slope,
       ROUND(AVG(CASE WHEN total_markdown > 0 THEN weekly_sales END) / AVG(CASE WHEN NOT total_markdown > 0 THEN weekly_sales END), 6) AS md_ratio
FROM panel GROUP BY store"""))
def k10_markdown_sensitivity(spark, sf_dir):
    m = fc.markdown_sensitivity(panel(spark, sf_dir))
    return m.select("store", rnd("md_slope", 6).alias("md_slope"), rnd("md_ratio", 6).alias("md_ratio"))


@register("k12_hierarchy_totals", q("""
SELECT CASE GROUPING_ID(store, dept) WHEN 0 THEN 'store_dept' WHEN 1 THEN 'store' ELSE 'total' END AS level,
       store, dept, CAST(SUM(CAST(weekly_sales AS DECIMAL(20,2))) AS DOUBLE) AS total
FROM panel GROUP BY ROLLUP (store, dept)"""))
def k12_hierarchy_totals(spark, sf_dir):
    return K.hierarchy_totals(panel(spark, sf_dir))


@register("k12_hierarchy_consistency", q("""
, t AS (SELECT store, SUM(CAST(weekly_sales AS DECIMAL(20,2))) AS s FROM panel GROUP BY store),
c AS (SELECT store, SUM(x) AS s FROM (SELECT store, dept, SUM(CAST(weekly_sales AS DECIMAL(20,2))) AS x FROM panel GROUP BY store, dept) GROUP BY store)
SELECT t.store, CAST(t.s AS DOUBLE) - CAST(c.s AS DOUBLE) AS gap FROM t JOIN c ON t.store = c.store"""))
def k12_hierarchy_consistency(spark, sf_dir):
    return K.hierarchy_consistency(K.hierarchy_totals(panel(spark, sf_dir)))


DRIFT_COLS = ["weekly_sales", "temperature", "fuel_price", "cpi"]


def _drift_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT week >= DATE '1998-01-05' AS rec, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM panel"
                               for c in DRIFT_COLS)
    return q(f"""
, long AS (SELECT * FROM ({parts}) WHERE value IS NOT NULL),
e AS (SELECT feature, MIN(value) AS lo, MAX(value) AS hi FROM long WHERE NOT rec GROUP BY feature),
x AS (SELECT l.*, CAST(CASE WHEN (e.hi - e.lo) / 10 = 0 THEN 0
                       ELSE least(greatest(floor((l.value - e.lo) / ((e.hi - e.lo) / 10)), 0), 9) END AS INTEGER) AS bin
      FROM long l JOIN e ON l.feature = e.feature),
cnt AS (SELECT feature, bin, SUM(CASE WHEN NOT rec THEN 1 ELSE 0 END) AS r, SUM(CASE WHEN rec THEN 1 ELSE 0 END) AS n FROM x GROUP BY 1, 2),
tot AS (SELECT feature, SUM(CASE WHEN NOT rec THEN 1 ELSE 0 END) AS rt, SUM(CASE WHEN rec THEN 1 ELSE 0 END) AS nt,
               AVG(CASE WHEN NOT rec THEN value END) AS ref_mean, AVG(CASE WHEN rec THEN value END) AS recent_mean FROM x GROUP BY 1)
SELECT cnt.feature, ROUND(tot.ref_mean, 6) AS ref_mean, ROUND(tot.recent_mean, 6) AS recent_mean,
       ROUND(SUM((greatest(n / nt, 1e-6) - greatest(r / rt, 1e-6)) * ln(greatest(n / nt, 1e-6) / greatest(r / rt, 1e-6))), 6) AS psi,
       ROUND(tot.recent_mean - tot.ref_mean, 6) AS mean_shift
FROM cnt JOIN tot ON cnt.feature = tot.feature GROUP BY cnt.feature, tot.ref_mean, tot.recent_mean""")


@register("k14_drift_report", _drift_sql())
def k14_drift_report(spark, sf_dir):
    d = K.drift_report(panel(spark, sf_dir), DRIFT_COLS, P.MARKDOWN_LAUNCH)
    return d.select("feature", *[rnd(c, 6).alias(c) for c in ("ref_mean", "recent_mean", "psi", "mean_shift")])


@register("k11_cluster_stability")
def k11_cluster_stability(spark, sf_dir):
    """Refit KMeans on the first and second half of the weeks; contingency of store labels."""
    p = panel(spark, sf_dir)
    mid = F.lit(p.agg(F.percentile_approx(F.unix_date("week"), 0.5).alias("m")).first()["m"])
    halves = []
    for name, cond in (("early", F.unix_date("week") <= mid), ("late", F.unix_date("week") > mid)):
        part = p.where(cond)
        v = fe.standardize(_materialized(H.entity_vectors(part)), COLS).fillna(0.0, subset=COLS)
        lab, _ = H.kmeans(v, COLS, 3, seed=42, n_init=30)
        halves.append(lab.select("store", F.col("cluster").alias(name)))
    return halves[0].join(halves[1], "store").groupBy("early", "late").agg(F.count(F.lit(1)).alias("stores"))


@register("k15_per_cluster_models")
def k15_per_cluster_models(spark, sf_dir):
    """One linear model per KMeans cluster of stores (H3), scored per cluster on the test split."""
    labels = h3_kmeans_labels(spark, sf_dir).select("store", "cluster")
    df = order.kept(M.model_frame(panel(spark, sf_dir)).join(labels, "store"))
    train, test = fe.temporal_split(df)
    preds = []
    for c in sorted(r["cluster"] for r in train.select("cluster").distinct().collect()):  # one row per cluster
        tr, te = train.where(F.col("cluster") == c), test.where(F.col("cluster") == c)
        preds.append(M.predict(M.fit_linear(tr, fe.FORECAST_FEATURES), te, f"linear_cluster_{c}"))
    return fc.leaderboard(preds)


@register("k16_k17_fallback_and_weights")
def k16_k17_fallback_and_weights(spark, sf_dir):
    """Lag-only fallback when exogenous inputs are missing, and a fit with the weeks that STL flags (G5) down-weighted."""
    from pyspark.ml.regression import LinearRegression
    keys = ["store", "dept", "week"]
    flags = g5_stl_anomalies(spark, sf_dir).select(*keys, "stl_anomaly")
    df = M.model_frame(panel(spark, sf_dir)).join(flags, keys, "left").fillna(0, subset=["stl_anomaly"])
    train, test = fe.temporal_split(order.kept(df))
    lag_feats = ["lag_1", "lag_4", "lag_52", "roll_4", "roll_12"]
    full = M.fit_linear(train, fe.FORECAST_FEATURES)
    lag_only = M.fit_linear(train, lag_feats)
    # exogenous inputs arrive late: the most recent four weeks have no CPI yet
    last = F.lit(test.agg(F.max("week").alias("_mx")).first()["_mx"])
    late = test.withColumn("cpi", F.when(F.col("week") > F.date_sub(last, 28), F.lit(None)).otherwise(F.col("cpi")))
    a = full.transform(late)  # a missing input gives a NaN prediction
    a = a.withColumn("prediction", F.when(F.isnan("prediction"), F.lit(None)).otherwise(F.col("prediction")))
    b = lag_only.transform(late).select("store", "dept", "week", F.col("prediction").alias("lag_pred"))
    comb = a.join(b, ["store", "dept", "week"]).withColumn("yhat", K.fallback_prediction(F.col("prediction"), F.col("lag_pred")))
    weighted_train = K.sample_weights(train, "stl_anomaly", 0.2)
    va = M._assembler(fe.FORECAST_FEATURES)
    wm = LinearRegression(featuresCol="features", labelCol="weekly_sales", weightCol="w").fit(va.transform(weighted_train))
    wp = wm.transform(va.transform(test))
    return fc.leaderboard([fc.predictions(comb, "full_with_lag_fallback", "yhat"),
                           fc.predictions(wp, "linear_downweighted_outliers", "prediction")])
