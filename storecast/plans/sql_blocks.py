"""Reusable SQL CTE blocks for the DuckDB oracle queries.

They restate the panel recipe and the wrangling steps in plain SQL so
each Spark operator can be checked against an independent engine.
"""

PANEL_SALES = """panel_sales AS (
  SELECT s_nationkey AS store, p_type AS dept,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
         CAST(SUM(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN -1 ELSE 1 END
                  * CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS weekly_sales,
         MAX(CASE WHEN weekofyear(l_shipdate) IN (6, 36, 47, 52) THEN 1 ELSE 0 END) AS is_holiday
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3)"""

PANEL_FEATURES = """li AS (
  SELECT s_nationkey AS store, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, COUNT(*) AS n,
         CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS q,
         CAST(SUM(CAST(l_tax AS DECIMAL(12,2))) AS DOUBLE) AS tx,
         CAST(SUM(CASE WHEN l_linenumber = 1 THEN CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) END) AS DOUBLE) AS md1,
         CAST(SUM(CASE WHEN l_linenumber = 2 THEN CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) END) AS DOUBLE) AS md2,
         CAST(SUM(CASE WHEN l_linenumber = 3 THEN CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) END) AS DOUBLE) AS md3,
         CAST(SUM(CASE WHEN l_linenumber = 4 THEN CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) END) AS DOUBLE) AS md4,
         CAST(SUM(CASE WHEN l_linenumber = 5 THEN CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) END) AS DOUBLE) AS md5
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
od AS (
  SELECT c_nationkey AS store, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, COUNT(*) AS n,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS tp,
         SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS nf
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
panel_features AS (
  SELECT li.store, li.week, li.q / li.n AS temperature, li.tx / li.n AS fuel_price,
         CASE WHEN li.week >= DATE '1998-01-05' THEN md1 END AS markdown1,
         CASE WHEN li.week >= DATE '1998-01-05' THEN md2 END AS markdown2,
         CASE WHEN li.week >= DATE '1998-01-05' THEN md3 END AS markdown3,
         CASE WHEN li.week >= DATE '1998-01-05' THEN md4 END AS markdown4,
         CASE WHEN li.week >= DATE '1998-01-05' THEN md5 END AS markdown5,
         od.tp / od.n AS cpi, 100.0E0 * od.nf / od.n AS unemployment
  FROM li LEFT JOIN od ON li.store = od.store AND li.week = od.week)"""

PANEL_STORES = """panel_stores AS (
  SELECT n_nationkey AS store,
         CASE WHEN n_nationkey % 5 < 2 THEN 'A' WHEN n_nationkey % 5 < 4 THEN 'B' ELSE 'C' END AS type,
         CAST(1000 * COUNT(s_suppkey) + 10 * n_nationkey AS BIGINT) AS size
  FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey)"""

_FILL = """COALESCE(last_value({c} IGNORE NULLS) OVER (PARTITION BY store ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  first_value({c} IGNORE NULLS) OVER (PARTITION BY store ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""

FEATURES_CLEAN = """features_clean AS (
  SELECT store, week, temperature, fuel_price,
         COALESCE(markdown1, 0) AS markdown1, COALESCE(markdown2, 0) AS markdown2,
         COALESCE(markdown3, 0) AS markdown3, COALESCE(markdown4, 0) AS markdown4,
         COALESCE(markdown5, 0) AS markdown5,
         """ + _FILL.format(c="cpi") + """,
         """ + _FILL.format(c="unemployment") + """
  FROM panel_features)"""

PANEL = """panel AS (
  SELECT s.store, s.dept, s.week, s.weekly_sales, s.is_holiday, f.temperature, f.fuel_price,
         f.markdown1, f.markdown2, f.markdown3, f.markdown4, f.markdown5, f.cpi, f.unemployment,
         st.type, st.size,
         COALESCE(f.markdown1, 0) + COALESCE(f.markdown2, 0) + COALESCE(f.markdown3, 0)
           + COALESCE(f.markdown4, 0) + COALESCE(f.markdown5, 0) AS total_markdown,
         CAST(year(s.week) AS INTEGER) AS year, CAST(month(s.week) AS INTEGER) AS month,
         CAST(weekofyear(s.week) AS INTEGER) AS week_of_year, CAST(day(s.week) AS INTEGER) AS day
  FROM panel_sales s LEFT JOIN features_clean f ON s.store = f.store AND s.week = f.week
       LEFT JOIN panel_stores st ON s.store = st.store)"""

_W = "PARTITION BY store, dept ORDER BY week"

ENGINEERED = """eng AS (
  SELECT *,
         lag(weekly_sales, 1) OVER (""" + _W + """) AS lag_1,
         lag(weekly_sales, 4) OVER (""" + _W + """) AS lag_4,
         lag(weekly_sales, 52) OVER (""" + _W + """) AS lag_52,
         CASE WHEN count(weekly_sales) OVER (""" + _W + """ ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4
              THEN avg(weekly_sales) OVER (""" + _W + """ ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS roll_4,
         CASE WHEN count(weekly_sales) OVER (""" + _W + """ ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) = 12
              THEN avg(weekly_sales) OVER (""" + _W + """ ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END AS roll_12
  FROM panel)"""

MODEL_ROWS = """model_rows AS (
  SELECT * FROM eng
  WHERE lag_1 IS NOT NULL AND lag_4 IS NOT NULL AND lag_52 IS NOT NULL
    AND roll_4 IS NOT NULL AND roll_12 IS NOT NULL)"""

SPLIT = """cutoff AS (
  SELECT quantile_cont(date_diff('day', DATE '1970-01-01', week), 0.8) AS cutoff_day FROM model_rows),
test_rows AS (
  SELECT m.* FROM model_rows m, cutoff c WHERE date_diff('day', DATE '1970-01-01', m.week) > c.cutoff_day),
train_rows AS (
  SELECT m.* FROM model_rows m, cutoff c WHERE date_diff('day', DATE '1970-01-01', m.week) <= c.cutoff_day)"""

BASE = [PANEL_SALES, PANEL_FEATURES, PANEL_STORES, FEATURES_CLEAN, PANEL]
MODEL = BASE + [ENGINEERED, MODEL_ROWS, SPLIT]


def with_ctes(blocks, body: str) -> str:
    return "WITH " + ",\n".join(blocks) + "\n" + body


def metrics_sql(y: str = "y", yhat: str = "yhat", hol: str = "is_holiday", digits: int = 2) -> str:
    e = f"({y} - {yhat})"
    w = f"CASE WHEN {hol} = 1 THEN 5.0E0 ELSE 1.0E0 END"
    return (f"COUNT(*) AS n, "
            f"ROUND(SUM({w} * abs({e})) / SUM({w}), {digits}) AS wmae, "
            f"ROUND(sqrt(SUM({e} * {e}) / COUNT(*)), {digits}) AS rmse, "
            f"ROUND(AVG(abs({e})), {digits}) AS mae, "
            f"ROUND(1 - SUM({e} * {e}) / (var_pop({y}) * COUNT(*)), {digits}) AS r2")
