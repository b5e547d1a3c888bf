"""Registered queries for anomaly detection (G1-G9) and the regular weekly grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from storecast.functions.scalar import rnd

from storecast.operators import anomaly as G
from storecast.operators import explore as D
from storecast.operators import windows
from storecast.operators import wrangle as C
from storecast.plans import sql_blocks as S
from storecast.plans.explore_queries import panel, q
from storecast.plans.registry import register
from storecast.sources import panel as P

_GRID = """bounds AS (SELECT store, dept, MIN(week) AS lo, MAX(week) AS hi FROM panel_sales GROUP BY store, dept),
g AS (SELECT store, dept, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week FROM bounds),
j AS (SELECT g.store, g.dept, g.week, s.weekly_sales AS y,
             row_number() OVER (PARTITION BY g.store, g.dept ORDER BY g.week) AS rp
      FROM g LEFT JOIN panel_sales s ON g.store = s.store AND g.dept = s.dept AND g.week = s.week),
k AS (SELECT *,
        last_value(y IGNORE NULLS) OVER (PARTITION BY store, dept ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
        last_value(CASE WHEN y IS NOT NULL THEN rp END IGNORE NULLS) OVER (PARTITION BY store, dept ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
        first_value(y IGNORE NULLS) OVER (PARTITION BY store, dept ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
        first_value(CASE WHEN y IS NOT NULL THEN rp END IGNORE NULLS) OVER (PARTITION BY store, dept ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
      FROM j),
interp AS (SELECT store, dept, week, y,
        CASE WHEN y IS NOT NULL THEN y WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
             ELSE pv + (rp - pp) / (np - pp) * (nv - pv) END AS yi
      FROM k)"""


def grid_interp(spark, sf_dir):
    s = P.panel_sales(spark, sf_dir).select("store", "dept", "week", "weekly_sales")
    g = windows.weekly_grid(s)
    return windows.interpolate_linear(g, "weekly_sales", out="_y")


@register("w4_w5_grid_interpolate", S.with_ctes([S.PANEL_SALES, _GRID], """
SELECT store, dept, week, y AS weekly_sales, ROUND(yi, 6) AS y_interp FROM interp"""))
def w4_w5_grid_interpolate(spark, sf_dir):
    g = grid_interp(spark, sf_dir)
    return g.select("store", "dept", "week", "weekly_sales", rnd("_y", 6).alias("y_interp"))


def _fx(e: str) -> str:
    return f"CAST(floor(({e}) * 10000.0E0 + 0.5E0) AS BIGINT)"


@register("g7_classical_decompose", S.with_ctes([S.PANEL_SALES, _GRID, """d AS (
  SELECT store, dept, week, yi,
         row_number() OVER (PARTITION BY store, dept ORDER BY week) - 1 AS i,
         CASE WHEN COUNT(yi) OVER (PARTITION BY store, dept ORDER BY week ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING) = 53
              THEN CAST(2 * SUM(""" + _fx("yi") + """) OVER (PARTITION BY store, dept ORDER BY week ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING)
                    - (lag(""" + _fx("yi") + """, 26) OVER (PARTITION BY store, dept ORDER BY week)
                       + lead(""" + _fx("yi") + """, 26) OVER (PARTITION BY store, dept ORDER BY week)) AS DOUBLE) / 1040000.0E0
         END AS trend
  FROM interp)""", """ph AS (SELECT store, dept, i % 52 AS ph,
         CAST(SUM(""" + _fx("yi - trend") + """) AS DOUBLE) / 10000.0E0 / COUNT(yi - trend) AS s
       FROM d GROUP BY store, dept, i % 52)""",
    """phc AS (SELECT store, dept, ph,
         s - CAST(SUM(""" + _fx("s") + """) OVER (PARTITION BY store, dept) AS DOUBLE) / 10000.0E0 / COUNT(s) OVER (PARTITION BY store, dept) AS seasonal
       FROM ph)"""], """
SELECT d.store, d.dept, d.week, ROUND(d.yi, 6) AS y,
       CAST(ROUND(CAST(d.trend AS DECIMAL(38,6)), 2) AS DOUBLE) AS trend,
       CAST(ROUND(CAST(phc.seasonal AS DECIMAL(38,6)), 2) AS DOUBLE) AS seasonal,
       CAST(ROUND(CAST(d.yi - d.trend - phc.seasonal AS DECIMAL(38,6)), 2) AS DOUBLE) AS resid
FROM d JOIN phc ON d.store = phc.store AND d.dept = phc.dept AND d.i % 52 = phc.ph"""))
def g7_classical_decompose(spark, sf_dir):
    dec = G.classical_decompose(grid_interp(spark, sf_dir))
    def cents(c):  # round through DECIMAL so half-way values round the same in every engine
        return F.round(F.col(c).cast("decimal(38,6)"), 2).cast("double").alias(c)
    return dec.select("store", "dept", "week", rnd("y", 6).alias("y"), cents("trend"), cents("seasonal"),
                      cents("resid"))


@register("g5_stl_anomalies")
def g5_stl_anomalies(spark, sf_dir):
    """Robust STL (period 52) residual z-scores on every series with >= 109 observed weeks."""
    s = P.panel_sales(spark, sf_dir).select("store", "dept", "week", "weekly_sales")
    return G.stl_anomalies(windows.weekly_grid(s))


@register("g7_stl_decompose")
def g7_stl_decompose(spark, sf_dir):
    """STL trend, seasonal and residual per grid week for every qualifying series."""
    return g5_stl_anomalies(spark, sf_dir).select("store", "dept", "week", "trend", "seasonal", "resid")


@register("g6_top_series", q("""
SELECT store, dept, ROUND(SUM(weekly_sales), 4) AS total FROM panel GROUP BY store, dept
ORDER BY SUM(weekly_sales) DESC, store, dept LIMIT 100"""))
def g6_top_series(spark, sf_dir):
    return G.top_series(panel(spark, sf_dir)).select("store", "dept", rnd("total", 4).alias("total"))


def if_scored(spark, sf_dir, trees=200):
    df = panel(spark, sf_dir)
    forest = G.fit_isolation_forest(df, trees=trees, psi=256, seed=42)
    forest = forest.checkpoint() if spark.sparkContext.getCheckpointDir() else forest.cache()
    return G.score_isolation_forest(df, forest)


@register("g1_isolation_forest")
def g1_isolation_forest(spark, sf_dir):
    """Isolation forest (200 trees, psi 256, seed 42); flags the top 1 % of scores."""
    return G.flag_top(if_scored(spark, sf_dir), "if_score", 0.01, "if_anomaly").select(
        "store", "dept", "week", "if_score", "if_anomaly")


@register("g2_contamination_sweep")
def g2_contamination_sweep(spark, sf_dir):
    return G.contamination_sweep(if_scored(spark, sf_dir), "if_score", [0.005, 0.01, 0.02, 0.03])


@register("g8_flagged_box_stats")
def g8_flagged_box_stats(spark, sf_dir):
    """Sales distribution for flagged vs not flagged rows (box statistics)."""
    f = G.flag_top(if_scored(spark, sf_dir), "if_score", 0.01, "if_anomaly")
    return D.box_stats(f, "if_anomaly", "weekly_sales")


def lof_rows(spark, sf_dir, sample: int | None = None):
    """All panel rows, or a seeded sample of ``sample`` rows (the sampling operator C16)."""
    df = panel(spark, sf_dir)
    return df if sample is None else C.sample_n(df, sample, 42, G.KEYS)


@register("g3_lof")
def g3_lof(spark, sf_dir):
    """LOF (k 35, 1 %) of every row with exact blocked kNN."""
    return G.lof(lof_rows(spark, sf_dir), k=35, contamination=0.01)


@register("g4_lof_sweep")
def g4_lof_sweep(spark, sf_dir):
    """k in {15, 25, 35, 50} from one kNN pass at k = 50: flagged share and holiday share."""
    from storecast.operators.features import standardize
    s = lof_rows(spark, sf_dir)
    x = standardize(s.select(*G.KEYS, *G.AD_COLS), G.AD_COLS).withColumn("_id", F.xxhash64(*[F.col(c) for c in G.KEYS]))
    neigh = G.knn(x, G.AD_COLS, 50)
    neigh = neigh.checkpoint() if spark.sparkContext.getCheckpointDir() else neigh.cache()
    out = None
    for k in (15, 25, 35, 50):
        sc = x.select("_id", "is_holiday").join(G.lof_scores(neigh, k), "_id")
        r = G.contamination_sweep(sc, "lof", [0.01]).select(F.lit(k).alias("k"), "flagged_share", "holiday_share")
        out = r if out is None else out.unionByName(r)
    return out


@register("g9_detector_overlap")
def g9_detector_overlap(spark, sf_dir):
    """Co-occurrence of the isolation-forest, LOF and STL flags; a row that a detector did not see has its flag 0."""
    f = G.flag_top(if_scored(spark, sf_dir), "if_score", 0.01, "if_anomaly").select(*G.KEYS, "if_anomaly")
    lof = g3_lof(spark, sf_dir).select(*G.KEYS, "lof_anomaly")
    stl = g5_stl_anomalies(spark, sf_dir).select(*G.KEYS, "stl_anomaly")
    f = f.join(lof, G.KEYS, "left").join(stl, G.KEYS, "left").fillna(0, subset=["lof_anomaly", "stl_anomaly"])
    return D.overlap_matrix(f, ["if_anomaly", "lof_anomaly", "stl_anomaly"])


@register("g5_g6_stl_flags_top_series")
def g5_g6_stl_flags_top_series(spark, sf_dir):
    """STL flags written back to the panel for the 100 largest series; all other rows 0."""
    return G.stl_flags_on_panel(panel(spark, sf_dir), 100).select("store", "dept", "week", "weekly_sales",
                                                                   "stl_anomaly")
