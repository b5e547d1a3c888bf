"""Registered queries for statistics: E1-E8."""

from __future__ import annotations

from pyspark.sql import functions as F

from storecast.functions.scalar import rnd

from storecast.functions import scalar
from storecast.operators import features as fe
from storecast.operators import stats as E
from storecast.plans.explore_queries import panel, q
from storecast.plans.registry import register
from storecast.sources import panel as P


def r(c, d=6):
    return rnd(c, d).alias(c)


def post_launch(spark, sf_dir):
    df = panel(spark, sf_dir).where(F.col("week") >= F.lit(P.MARKDOWN_LAUNCH).cast("date"))
    return df.withColumn("active", scalar.flag(F.col("total_markdown") > 0))


@register("e1_welch_t", q("""
, s AS (SELECT COUNT(CASE WHEN is_holiday = 1 THEN weekly_sales END) AS n1, AVG(CASE WHEN is_holiday = 1 THEN weekly_sales END) AS mean1,
               var_samp(CASE WHEN is_holiday = 1 THEN weekly_sales END) AS var1,
               COUNT(CASE WHEN is_holiday <> 1 THEN weekly_sales END) AS n0, AVG(CASE WHEN is_holiday <> 1 THEN weekly_sales END) AS mean0,
               var_samp(CASE WHEN is_holiday <> 1 THEN weekly_sales END) AS var0 FROM panel)
SELECT n1, n0, ROUND(mean1, 6) AS mean1, ROUND(mean0, 6) AS mean0,
       ROUND((mean1 - mean0) / sqrt(var1 / n1 + var0 / n0), 6) AS t,
       ROUND((var1 / n1 + var0 / n0) * (var1 / n1 + var0 / n0)
             / ((var1 / n1) * (var1 / n1) / (n1 - 1) + (var0 / n0) * (var0 / n0) / (n0 - 1)), 4) AS df
FROM s"""))
def e1_welch_t(spark, sf_dir):
    t = E.welch_t(panel(spark, sf_dir), "weekly_sales", "is_holiday", p_value=False)
    return t.select("n1", "n0", r("mean1"), r("mean0"), r("t"), r("df", 4))


@register("e1_welch_t_pvalue")
def e1_welch_t_pvalue(spark, sf_dir):
    return E.welch_t(panel(spark, sf_dir), "weekly_sales", "is_holiday", alternative="greater")


@register("e2_anova", q("""
, g AS (SELECT type, COUNT(*) AS n, AVG(weekly_sales) AS m, var_pop(weekly_sales) * COUNT(*) AS m2 FROM panel GROUP BY type),
tot AS (SELECT AVG(weekly_sales) AS gm, COUNT(*) AS nn FROM panel),
s AS (SELECT SUM(n * (m - gm) * (m - gm)) AS ssb, SUM(m2) AS ssw, COUNT(*) AS k, MAX(nn) AS nn FROM g, tot)
SELECT CAST(k - 1 AS BIGINT) AS df_between, CAST(nn - k AS BIGINT) AS df_within,
       ROUND((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS f FROM s"""))
def e2_anova(spark, sf_dir):
    a = E.anova(panel(spark, sf_dir), "weekly_sales", "type", p_value=False)
    return a.select("df_between", "df_within", r("f"))


@register("e2_anova_pvalue", q("""
, g AS (SELECT type, COUNT(*) AS n, AVG(weekly_sales) AS m, var_pop(weekly_sales) * COUNT(*) AS m2 FROM panel GROUP BY type),
tot AS (SELECT AVG(weekly_sales) AS gm, COUNT(*) AS nn FROM panel),
s AS (SELECT SUM(n * (m - gm) * (m - gm)) AS ssb, SUM(m2) AS ssw, COUNT(*) AS k, MAX(nn) AS nn FROM g, tot),
f AS (SELECT (ssb / (k - 1)) / (ssw / (nn - k)) AS f, CAST(nn - k AS DOUBLE) AS d2 FROM s)
SELECT ROUND(f, 6) AS f, ROUND(pow(d2 / (d2 + 2 * f), d2 / 2), 8) AS p_value FROM f"""))
def e2_anova_pvalue(spark, sf_dir):
    """F and its tail over the three store types (two numerator degrees: a closed form)."""
    a = E.anova(panel(spark, sf_dir), "weekly_sales", "type")
    return a.select(r("f"), r("p_value", 8))


_RANK_SQL = """
, rk AS (SELECT {g} AS grp, weekly_sales AS v,
                rank() OVER (ORDER BY weekly_sales) + (COUNT(*) OVER (PARTITION BY weekly_sales) - 1) / 2.0E0 AS r
         FROM {src}),
g AS (SELECT grp, COUNT(*) AS n, SUM(r) AS rs FROM rk GROUP BY grp),
tt AS (SELECT SUM(c * c * c - c) AS tie_term, SUM(c) AS nn FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS c FROM {src} GROUP BY weekly_sales))
"""


@register("e3_kruskal", q(_RANK_SQL.format(g="type", src="panel") + """
SELECT ROUND((12.0E0 / (nn * (nn + 1)) * (SELECT SUM(rs * rs / n) FROM g) - 3 * (nn + 1)) / (1 - tie_term / (nn * nn * nn - nn)), 6) AS h,
       (SELECT COUNT(*) - 1 FROM g) AS df, CAST(nn AS BIGINT) AS n FROM tt"""))
def e3_kruskal(spark, sf_dir):
    k = E.kruskal(panel(spark, sf_dir), "weekly_sales", "type", p_value=False)
    return k.select(r("h"), "df", "n")


@register("e3_kruskal_pvalue", q(_RANK_SQL.format(g="type", src="panel") + """
, h AS (SELECT (12.0E0 / (nn * (nn + 1)) * (SELECT SUM(rs * rs / n) FROM g) - 3 * (nn + 1)) / (1 - tie_term / (nn * nn * nn - nn)) AS h FROM tt)
SELECT ROUND(h, 6) AS h, ROUND(exp(-h / 2), 8) AS p_value FROM h"""))
def e3_kruskal_pvalue(spark, sf_dir):
    """H and its tail over the three store types (two degrees: a closed form)."""
    k = E.kruskal(panel(spark, sf_dir), "weekly_sales", "type")
    return k.select(r("h"), r("p_value", 8))


_POST = """post AS (SELECT *, CASE WHEN total_markdown > 0 THEN 1 ELSE 0 END AS active FROM panel
                 WHERE week >= DATE '1998-01-05')"""


@register("e4_mann_whitney", q(",\n" + _POST + _RANK_SQL.format(g="active", src="post") + """
, s AS (SELECT SUM(CASE WHEN grp = 1 THEN rs END) AS r1, CAST(SUM(CASE WHEN grp = 1 THEN n END) AS DOUBLE) AS n1,
               CAST(SUM(CASE WHEN grp = 0 THEN n END) AS DOUBLE) AS n0 FROM g)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, r1 - n1 * (n1 + 1) / 2 AS u,
       ROUND((r1 - n1 * (n1 + 1) / 2 - n1 * n0 / 2 - 0.5)
             / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - tie_term / ((n1 + n0) * (n1 + n0 - 1)))), 6) AS z
FROM s, tt"""))
def e4_mann_whitney(spark, sf_dir):
    m = E.mann_whitney(post_launch(spark, sf_dir), "weekly_sales", "active", p_value=False)
    return m.select("n1", "n0", "u", r("z"))


@register("e4_mann_whitney_pvalue")
def e4_mann_whitney_pvalue(spark, sf_dir):
    return E.mann_whitney(post_launch(spark, sf_dir), "weekly_sales", "active")


@register("e5_iqr_fence", q("""
, qs AS (SELECT quantile_cont(weekly_sales, 0.25) AS q1, quantile_cont(weekly_sales, 0.75) AS q3 FROM panel)
SELECT ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(q3 - q1, 6) AS iqr, ROUND(q1 - 1.5 * (q3 - q1), 6) AS lower,
       ROUND(q3 + 1.5 * (q3 - q1), 6) AS upper,
       ROUND(AVG(CASE WHEN weekly_sales > q3 + 1.5 * (q3 - q1) THEN 1.0E0 ELSE 0.0E0 END), 8) AS share_above,
       CAST(SUM(CASE WHEN weekly_sales < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives
FROM panel, qs GROUP BY q1, q3"""))
def e5_iqr_fence(spark, sf_dir):
    df = panel(spark, sf_dir)
    f = fe.iqr_fence(df).first()
    return df.agg(*[rnd(F.lit(f[c]), 6).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")],
                  rnd(F.avg(scalar.flag(F.col("weekly_sales") > F.lit(f["upper"])).cast("double")), 8).alias("share_above"),
                  F.sum(scalar.flag(F.col("weekly_sales") < 0)).cast("bigint").alias("negatives"))


STD_COLS = ["weekly_sales", "temperature", "fuel_price", "size"]


@register("e7_standardize", q("""
, m AS (SELECT """ + ", ".join(f"AVG({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in STD_COLS) + """ FROM panel)
SELECT store, dept, week, """ + ", ".join(f"ROUND(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in STD_COLS) + """
FROM panel, m"""))
def e7_standardize(spark, sf_dir):
    z = fe.standardize(panel(spark, sf_dir), STD_COLS)
    return z.select("store", "dept", "week", *[r(c) for c in STD_COLS])


@register("e8_pca")
def e8_pca(spark, sf_dir):
    """PCA(2) of store vectors' numeric columns on the panel rows (scores per row)."""
    scored, _ = E.pca(panel(spark, sf_dir), ["weekly_sales", "temperature", "fuel_price", "total_markdown"], 2)
    return scored.select("store", "dept", "week", "pc1", "pc2")
