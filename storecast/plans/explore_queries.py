"""Registered queries for profiling (B), wrangling (C) and exploratory aggregates (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from storecast.functions.scalar import rnd

from storecast.functions import scalar
from storecast.operators import explore as D
from storecast.operators import features as fe
from storecast.operators import profile as B
from storecast.operators import wrangle as C
from storecast.plans import sql_blocks as S
from storecast.plans.registry import register
from storecast.sources import panel as P

PANEL_COLS = ["store", "dept", "week", "weekly_sales", "is_holiday", "temperature", "fuel_price",
              "markdown1", "markdown2", "markdown3", "markdown4", "markdown5", "cpi", "unemployment",
              "type", "size", "total_markdown", "year", "month", "week_of_year", "day"]
FEATURE_COLS = ["store", "week", "temperature", "fuel_price", "markdown1", "markdown2", "markdown3",
                "markdown4", "markdown5", "cpi", "unemployment"]
NUMERIC = ["weekly_sales", "temperature", "fuel_price", "cpi", "unemployment", "size", "total_markdown"]
LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
CORR_COLS = ["weekly_sales", "temperature", "fuel_price", "markdown1", "markdown2", "markdown3", "markdown4",
             "markdown5", "cpi", "unemployment", "size", "total_markdown"]


def panel(spark, sf_dir):
    return P.wrangled_panel(spark, sf_dir)


def q(body: str, blocks=None) -> str:
    """WITH <panel CTEs> body; a body that starts with ", name AS (...)" adds more CTEs."""
    return "WITH " + ",\n".join(blocks or S.BASE) + ("" if body.lstrip().startswith(",") else "\n") + body


def r(c: str, d: int = 6):
    return rnd(c, d).alias(c)


# ---- B profiling ------------------------------------------------------------

@register("b1_head", q("SELECT * FROM panel ORDER BY store, dept, week LIMIT 10"))
def b1_head(spark, sf_dir):
    return B.head(panel(spark, sf_dir), 10, ["store", "dept", "week"])


@register("b2_shape", q("""
SELECT 'sales' AS "table", COUNT(*) AS rows, 5 AS cols FROM panel_sales
UNION ALL SELECT 'features', COUNT(*), 11 FROM panel_features
UNION ALL SELECT 'stores', COUNT(*), 3 FROM panel_stores"""))
def b2_shape(spark, sf_dir):
    return B.shape({"sales": P.panel_sales(spark, sf_dir), "features": P.panel_features(spark, sf_dir),
                    "stores": P.panel_stores(spark, sf_dir)})


@register("b3_table_info", q(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", COUNT({c}) AS non_null FROM panel" for i, c in enumerate(PANEL_COLS))))
def b3_table_info(spark, sf_dir):
    return B.table_info(panel(spark, sf_dir)).select("position", "column", "non_null")


@register("b4_duplicate_count", f"""
SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT COUNT(*) AS c FROM lineitem GROUP BY {', '.join(LINEITEM_COLS)})""")
def b4_duplicate_count(spark, sf_dir):
    from storecast.sources.tables import read_table
    return B.duplicate_count(read_table(spark, sf_dir, "lineitem"))


@register("b5_null_counts", q("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(SUM(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM panel_features"
    if c not in ("store", "week") else
    f"SELECT '{c}' AS \"column\", CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM panel_features"
    for c in FEATURE_COLS) + ") WHERE nulls > 0"))
def b5_null_counts(spark, sf_dir):
    return B.null_counts(P.panel_features(spark, sf_dir))


@register("b13_null_total", q("SELECT CAST(" + " + ".join(
    f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in PANEL_COLS) + " AS BIGINT) AS null_total FROM panel"))
def b13_null_total(spark, sf_dir):
    return B.null_total(panel(spark, sf_dir))


@register("b6_missingness_by_week", q("""
SELECT week, """ + ", ".join(f"AVG(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}" for c in FEATURE_COLS[2:]) + """
FROM panel_features GROUP BY week"""))
def b6_missingness_by_week(spark, sf_dir):
    return B.missingness_by(P.panel_features(spark, sf_dir), "week", FEATURE_COLS[2:])


def _describe_sql(table: str, cols: list[str]) -> str:
    return q(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, ROUND(stddev_samp({c}), 6) AS std,
       CAST(MIN({c}) AS DOUBLE) AS min, ROUND(quantile_cont({c}, 0.25), 6) AS p25, ROUND(quantile_cont({c}, 0.5), 6) AS p50,
       ROUND(quantile_cont({c}, 0.75), 6) AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM {table}""" for c in cols))


def _described(df, cols):
    d = B.describe(df, cols)
    return d.select("column", "count", r("mean"), r("std"), "min", r("p25"), r("p50"), r("p75"), "max")


@register("b8_describe", _describe_sql("panel", NUMERIC + P.MARKDOWN_COLS))
def b8_describe(spark, sf_dir):
    return _described(panel(spark, sf_dir), NUMERIC + P.MARKDOWN_COLS)


@register("b8_describe_features", _describe_sql("panel_features", FEATURE_COLS[2:]))
def b8_describe_features(spark, sf_dir):
    return _described(P.panel_features(spark, sf_dir), FEATURE_COLS[2:])


@register("b8_describe_stores", _describe_sql("panel_stores", ["store", "size"]))
def b8_describe_stores(spark, sf_dir):
    return _described(P.panel_stores(spark, sf_dir), ["store", "size"])


@register("c5_validated_joins", q("SELECT type, COUNT(*) AS rows, COUNT(DISTINCT store) AS stores FROM panel GROUP BY type"))
def c5_validated_joins(spark, sf_dir):
    """The panel with both many-to-one joins checked: a repeated right key raises."""
    df = P.wrangled_panel(spark, sf_dir, validate=True)
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("store").alias("stores"))


@register("b9_cardinality", q("""
SELECT 'store' AS "column", COUNT(DISTINCT store) AS "distinct" FROM panel
UNION ALL SELECT 'dept', COUNT(DISTINCT dept) FROM panel
UNION ALL SELECT 'week', COUNT(DISTINCT week) FROM panel"""))
def b9_cardinality(spark, sf_dir):
    return B.cardinality(panel(spark, sf_dir), ["store", "dept", "week"])


@register("b10_span", q("SELECT MIN(week) AS min_date, MAX(week) AS max_date FROM panel"))
def b10_span(spark, sf_dir):
    return B.span(panel(spark, sf_dir), "week")


@register("b11_value_counts", q("""
SELECT is_holiday, COUNT(*) AS count, COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM panel GROUP BY is_holiday"""))
def b11_value_counts(spark, sf_dir):
    return B.value_counts(panel(spark, sf_dir), "is_holiday", normalize=True)


@register("d3_store_type_counts", q("SELECT type, COUNT(*) AS count FROM panel_stores GROUP BY type"))
def d3_store_type_counts(spark, sf_dir):
    return B.value_counts(P.panel_stores(spark, sf_dir), "type")


@register("b12_rate", q("SELECT AVG(CAST(is_holiday AS DOUBLE)) AS is_holiday_rate FROM panel"))
def b12_rate(spark, sf_dir):
    return B.rate(panel(spark, sf_dir), "is_holiday")


# ---- C wrangling ------------------------------------------------------------

@register("c10_c11_filter_project", q("""
SELECT store, dept, week, weekly_sales, total_markdown FROM panel
WHERE week >= DATE '1998-01-05' AND is_holiday = 1 AND NOT (weekly_sales < 0) AND total_markdown > 0"""))
def c10_c11_filter_project(spark, sf_dir):
    df = panel(spark, sf_dir)
    df = df.where((F.col("week") >= F.lit("1998-01-05").cast("date")) & (F.col("is_holiday") == 1)
                  & ~(F.col("weekly_sales") < 0) & (F.col("total_markdown") > 0))
    return C.select_existing(df, ["store", "dept", "week", "weekly_sales", "total_markdown", "not_a_column"])


@register("c12_c13_c15_rename_clip_dropna", q("""
SELECT store AS store_id, week AS date, greatest(weekly_sales, 0) AS sales_clipped
FROM panel WHERE cpi IS NOT NULL AND unemployment IS NOT NULL"""))
def c12_c13_c15_rename_clip_dropna(spark, sf_dir):
    df = panel(spark, sf_dir).dropna(subset=["cpi", "unemployment"])
    df = df.withColumnRenamed("store", "store_id").withColumnRenamed("week", "date")
    return df.select("store_id", "date", C.clip_lower("weekly_sales", 0.0).alias("sales_clipped"))


@register("c6_c14_store_lookup_join", q("""
, st AS (SELECT store, AVG(weekly_sales) AS mean_sales FROM panel GROUP BY store)
SELECT st.store, ROUND(st.mean_sales, 6) AS mean_sales, s.type
FROM st JOIN panel_stores s ON st.store = s.store"""))
def c6_c14_store_lookup_join(spark, sf_dir):
    df = panel(spark, sf_dir).groupBy("store").agg(F.avg("weekly_sales").alias("mean_sales"))
    stores = P.panel_stores(spark, sf_dir).select("store", "type")
    return df.join(stores, "store", "inner").select("store", r("mean_sales"), "type")


_MD5 = "md5(concat_ws('|', CAST(store AS VARCHAR), CAST(dept AS VARCHAR), CAST(week AS VARCHAR), '42'))"


@register("c16_sample_n", q(f"SELECT * FROM panel ORDER BY {_MD5} LIMIT 2000"))
def c16_sample_n(spark, sf_dir):
    """Seeded exact-n sample (a sampling operator: the limit is the feature)."""
    return C.sample_n(panel(spark, sf_dir), 2000, 42, ["store", "dept", "week"])


@register("c17_top_k", q("""
SELECT store, dept, week, weekly_sales FROM panel ORDER BY weekly_sales DESC, store, dept, week LIMIT 10"""))
def c17_top_k(spark, sf_dir):
    return C.top_k(panel(spark, sf_dir), "weekly_sales", 10, tie_keys=["store", "dept", "week"]).select(
        "store", "dept", "week", "weekly_sales")


# ---- D exploratory aggregates ----------------------------------------------

def _hist_sql(expr: str, bins: int, src: str = "panel") -> str:
    return f"""
, x AS (SELECT CAST({expr} AS DOUBLE) AS x FROM {src} WHERE {expr} IS NOT NULL),
e AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM x),
c AS (SELECT CAST(CASE WHEN (e.hi - e.lo) / {bins}.0E0 = 0 THEN 0
                   ELSE least(floor((x.x - e.lo) / ((e.hi - e.lo) / {bins}.0E0)), {bins - 1}) END AS INTEGER) AS bin,
             COUNT(*) AS cnt FROM x, e GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, e.lo + g.bin * ((e.hi - e.lo) / {bins}.0E0) AS lo,
       e.lo + (g.bin + 1) * ((e.hi - e.lo) / {bins}.0E0) AS hi, CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) g LEFT JOIN c ON g.bin = c.bin, e"""


def _cte_join(body: str) -> str:
    return q(body)


@register("d1_histogram", _cte_join(_hist_sql("weekly_sales", 80)))
def d1_histogram(spark, sf_dir):
    return D.histogram(panel(spark, sf_dir), "weekly_sales", 80)


@register("d2_log_histogram", _cte_join(_hist_sql("ln(1 + greatest(weekly_sales, 0))", 80)))
def d2_log_histogram(spark, sf_dir):
    return D.histogram(panel(spark, sf_dir), scalar.log1p_clipped("weekly_sales"), 80)


@register("d4_histogram_by_type", "WITH " + S.PANEL_STORES + """,
x AS (SELECT type, CAST(size AS DOUBLE) AS x FROM panel_stores),
e AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM x)
SELECT type, CAST(least(floor((x.x - e.lo) / ((e.hi - e.lo) / 20.0E0)), 19) AS INTEGER) AS bin,
       e.lo + least(floor((x.x - e.lo) / ((e.hi - e.lo) / 20.0E0)), 19) * ((e.hi - e.lo) / 20.0E0) AS lo,
       e.lo + (least(floor((x.x - e.lo) / ((e.hi - e.lo) / 20.0E0)), 19) + 1) * ((e.hi - e.lo) / 20.0E0) AS hi,
       COUNT(*) AS count
FROM x, e GROUP BY 1, 2, 3, 4""")
def d4_histogram_by_type(spark, sf_dir):
    return D.histogram(P.panel_stores(spark, sf_dir), "size", 20, by="type")


@register("d5_holiday_share", q("""
, per AS (SELECT week, MAX(is_holiday) AS is_holiday FROM panel GROUP BY week)
SELECT l.is_holiday, CAST(COALESCE(c.dates, 0) AS BIGINT) AS dates, COALESCE(c.dates, 0) / t.n AS share
FROM (SELECT CAST(range AS INTEGER) AS is_holiday FROM range(2)) l
LEFT JOIN (SELECT is_holiday, COUNT(*) AS dates FROM per GROUP BY is_holiday) c ON l.is_holiday = c.is_holiday,
(SELECT COUNT(*) AS n FROM per) t"""))
def d5_holiday_share(spark, sf_dir):
    return D.holiday_share(panel(spark, sf_dir))


@register("d6_weekly_totals", q("""
SELECT week, ROUND(SUM(weekly_sales), 4) AS total_sales, MAX(is_holiday) AS is_holiday FROM panel GROUP BY week"""))
def d6_weekly_totals(spark, sf_dir):
    return D.weekly_totals(panel(spark, sf_dir)).withColumn("total_sales", rnd("total_sales", 4))


def _box_sql(by: str) -> str:
    return q(f"""
, qs AS (SELECT {by}, quantile_cont(weekly_sales, 0.25) AS q1, quantile_cont(weekly_sales, 0.5) AS median,
                quantile_cont(weekly_sales, 0.75) AS q3 FROM panel GROUP BY {by})
SELECT p.{by}, ROUND(qs.q1, 6) AS q1, ROUND(qs.median, 6) AS median, ROUND(qs.q3, 6) AS q3,
       MIN(CASE WHEN weekly_sales BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN weekly_sales END) AS whisker_lo,
       MAX(CASE WHEN weekly_sales BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN weekly_sales END) AS whisker_hi,
       CAST(SUM(CASE WHEN weekly_sales BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS fliers,
       COUNT(*) AS n
FROM panel p JOIN qs ON p.{by} = qs.{by} GROUP BY p.{by}, qs.q1, qs.median, qs.q3""")


@register("d7_box_stats_by_type", _box_sql("type"))
def d7_box_stats_by_type(spark, sf_dir):
    b = D.box_stats(panel(spark, sf_dir), "type", "weekly_sales")
    return b.select("type", r("q1"), r("median"), r("q3"), "whisker_lo", "whisker_hi", "fliers", "n")


@register("d7_box_stats_by_month", _box_sql("month"))
def d7_box_stats_by_month(spark, sf_dir):
    b = D.box_stats(panel(spark, sf_dir), "month", "weekly_sales")
    return b.select("month", r("q1"), r("median"), r("q3"), "whisker_lo", "whisker_hi", "fliers", "n")


@register("d8_holiday_lift", q("""
SELECT ROUND(AVG(CASE WHEN is_holiday = 1 THEN weekly_sales END), 6) AS mean_1,
       ROUND(AVG(CASE WHEN is_holiday = 0 THEN weekly_sales END), 6) AS mean_0,
       ROUND(AVG(CASE WHEN is_holiday = 1 THEN weekly_sales END) / AVG(CASE WHEN is_holiday = 0 THEN weekly_sales END) - 1, 6) AS lift
FROM panel"""))
def d8_holiday_lift(spark, sf_dir):
    return D.lift(panel(spark, sf_dir), "is_holiday", "weekly_sales").select(r("mean_1"), r("mean_0"), r("lift"))


@register("d9_pareto", q("""
, g AS (SELECT dept, SUM(weekly_sales) AS total FROM panel GROUP BY dept),
top AS (SELECT * FROM g ORDER BY total DESC, dept LIMIT 15)
SELECT dept, ROUND(total, 4) AS total, CAST(row_number() OVER (ORDER BY total DESC, dept) AS INTEGER) AS rank,
       ROUND(total / (SELECT SUM(weekly_sales) FROM panel), 6) AS share,
       ROUND(SUM(total) OVER (ORDER BY total DESC, dept ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / (SELECT SUM(weekly_sales) FROM panel), 6) AS cum_share
FROM top"""))
def d9_pareto(spark, sf_dir):
    p = D.pareto(panel(spark, sf_dir), "dept", "weekly_sales", 15)
    return p.select("dept", rnd("total", 4).alias("total"), "rank", r("share"), r("cum_share"))


@register("d10_store_summary", q("""
SELECT store, type, size, ROUND(AVG(weekly_sales), 6) AS mean_sales FROM panel GROUP BY store, type, size"""))
def d10_store_summary(spark, sf_dir):
    return D.store_summary(panel(spark, sf_dir)).withColumn("mean_sales", rnd("mean_sales", 6))


@register("d11_markdown_coverage", q("""
SELECT week, AVG(CASE WHEN total_markdown > 0 THEN 1.0E0 ELSE 0.0E0 END) AS coverage FROM panel GROUP BY week"""))
def d11_markdown_coverage(spark, sf_dir):
    return D.coverage(panel(spark, sf_dir))


@register("d12_postlaunch_sample", q(f"""
SELECT total_markdown, weekly_sales FROM panel WHERE week >= DATE '1998-01-05' ORDER BY {_MD5} LIMIT 20000"""))
def d12_postlaunch_sample(spark, sf_dir):
    """Post-launch markdown vs sales sample (sampling operator)."""
    df = panel(spark, sf_dir).where(F.col("week") >= F.lit(P.MARKDOWN_LAUNCH).cast("date"))
    return C.sample_n(df, 20000, 42, ["store", "dept", "week"]).select("total_markdown", "weekly_sales")


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i + 1:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, ROUND(corr({a}, {b}), 8) AS r FROM panel")
            parts.append(f"SELECT '{b}' AS a, '{a}' AS b, ROUND(corr({a}, {b}), 8) AS r FROM panel")
    parts += [f"SELECT '{c}' AS a, '{c}' AS b, 1.0E0 AS r" for c in CORR_COLS]
    return q(" UNION ALL ".join(parts))


@register("d13_corr_matrix", _corr_sql())
def d13_corr_matrix(spark, sf_dir):
    return D.corr_matrix(panel(spark, sf_dir), CORR_COLS).withColumn("r", rnd("r", 8))


@register("d14_kde_by_type", q("""
, x AS (SELECT type, weekly_sales AS v FROM panel),
st AS (SELECT type, COUNT(*) AS n, stddev_samp(v) AS s, MIN(v) AS mn, MAX(v) AS mx,
              pow(CAST(COUNT(*) AS DOUBLE), -0.2) * stddev_samp(v) AS bw FROM x GROUP BY type),
grid AS (SELECT type, CAST(gi AS INTEGER) AS gi, n, bw,
                (mn - 3.0 * bw) + gi * ((mx - mn + 2 * 3.0 * bw) / 199.0E0) AS gx
         FROM st, range(200) t(gi))
SELECT g.type, g.gi, ROUND(g.gx, 4) AS x,
       ROUND(SUM(exp(-0.5 * ((x.v - g.gx) / g.bw) * ((x.v - g.gx) / g.bw))) / (g.n * g.bw * sqrt(2 * pi())) * 1e9, 4) AS density_e9
FROM x JOIN grid g ON x.type = g.type GROUP BY g.type, g.gi, g.gx, g.n, g.bw"""))
def d14_kde_by_type(spark, sf_dir):
    k = D.kde(panel(spark, sf_dir), "weekly_sales", "type", grid_size=200)
    return k.select("type", "gi", rnd("x", 4).alias("x"), rnd(F.col("density") * 1e9, 4).alias("density_e9"))


@register("d15_mean_by_type_holiday", q("""
SELECT type, is_holiday, ROUND(AVG(weekly_sales), 6) AS mean_sales FROM panel GROUP BY type, is_holiday"""))
def d15_mean_by_type_holiday(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("type", "is_holiday").agg(rnd(F.avg("weekly_sales"), 6).alias("mean_sales"))


@register("d16_rounded_mean_and_medians", q("""
, post AS (SELECT * FROM panel WHERE week >= DATE '1998-01-05')
SELECT CASE WHEN total_markdown > 0 THEN 1 ELSE 0 END AS active, ROUND(AVG(weekly_sales), 0) AS mean_sales,
       ROUND(median(weekly_sales), 6) AS median_sales
FROM post WHERE total_markdown >= 0 GROUP BY 1"""))
def d16_rounded_mean_and_medians(spark, sf_dir):
    from storecast.operators import order
    post = panel(spark, sf_dir).where(F.col("week") >= F.lit(P.MARKDOWN_LAUNCH).cast("date"))
    post = post.where(F.col("total_markdown") >= 0).withColumn("active", scalar.flag(F.col("total_markdown") > 0))
    means = post.groupBy("active").agg(rnd(F.avg("weekly_sales"), 0).alias("mean_sales"))
    med = order.quantiles(post, "weekly_sales", [0.5], by=["active"], names=["median_sales"])
    return means.join(med, "active").select("active", "mean_sales", r("median_sales"))


FLAGS = ["is_holiday", "has_markdown", "is_negative", "is_outlier_iqr"]


@register("d17_flag_overlap", q("""
, qs AS (SELECT quantile_cont(weekly_sales, 0.25) AS q1, quantile_cont(weekly_sales, 0.75) AS q3 FROM panel),
f AS (SELECT is_holiday, CASE WHEN total_markdown > 0 THEN 1 ELSE 0 END AS has_markdown,
             CASE WHEN weekly_sales < 0 THEN 1 ELSE 0 END AS is_negative,
             CASE WHEN weekly_sales < q1 - 1.5 * (q3 - q1) OR weekly_sales > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END AS is_outlier_iqr
      FROM panel, qs)
""" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST(SUM({a} * {b}) AS BIGINT) AS both FROM f"
                          for a in FLAGS for b in FLAGS)))
def d17_flag_overlap(spark, sf_dir):
    df = fe.iqr_flags(panel(spark, sf_dir)).withColumn("has_markdown", scalar.flag(F.col("total_markdown") > 0))
    return D.overlap_matrix(df, FLAGS)
