"""Registered queries for market baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from storecast.functions.scalar import rnd

from storecast.operators import basket as J
from storecast.operators import explore as D
from storecast.plans.explore_queries import panel, q
from storecast.plans.registry import register
from storecast.sources.tables import Tables

PANEL_SUPPORT = 0.05
ORDER_SUPPORT = 0.002

_THR = "thr AS (SELECT dept, median(weekly_sales) * 0.5 AS threshold FROM panel GROUP BY dept)"
_PANEL_ACT = """act AS (SELECT DISTINCT p.store AS b1, p.week AS b2, p.dept AS item FROM panel p JOIN thr ON p.dept = thr.dept
                 WHERE p.weekly_sales >= thr.threshold),
nb AS (SELECT COUNT(*) AS n FROM (SELECT DISTINCT store, week FROM panel))"""
_ORDER_ACT = """act AS (SELECT DISTINCT l_orderkey AS b1, 0 AS b2, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
nb AS (SELECT COUNT(DISTINCT b1) AS n FROM act)"""


def _itemsets_ctes(s: float) -> str:
    return f"""s1 AS (SELECT item AS i1, COUNT(*) AS c FROM act GROUP BY item HAVING COUNT(*) >= {s} * (SELECT n FROM nb)),
a1 AS (SELECT act.* FROM act JOIN s1 ON act.item = s1.i1),
s2 AS (SELECT a.item AS i1, b.item AS i2, COUNT(*) AS c FROM a1 a JOIN a1 b ON a.b1 = b.b1 AND a.b2 = b.b2 AND a.item < b.item
       GROUP BY 1, 2 HAVING COUNT(*) >= {s} * (SELECT n FROM nb)),
s3 AS (SELECT a.item AS i1, b.item AS i2, c.item AS i3, COUNT(*) AS c
       FROM a1 a JOIN a1 b ON a.b1 = b.b1 AND a.b2 = b.b2 AND a.item < b.item
                 JOIN a1 c ON a.b1 = c.b1 AND a.b2 = c.b2 AND b.item < c.item
       GROUP BY 1, 2, 3 HAVING COUNT(*) >= {s} * (SELECT n FROM nb)),
itemsets AS (
  SELECT i1 AS k, 1 AS size, c FROM s1
  UNION ALL SELECT i1 || ', ' || i2, 2, c FROM s2
  UNION ALL SELECT i1 || ', ' || i2 || ', ' || i3, 3, c FROM s3)"""


_ITEMSETS_SELECT = """
SELECT k AS itemset_str, size, CAST(c AS BIGINT) AS count, c / (SELECT n FROM nb) AS support FROM itemsets"""

_RULES_CTE = """rules AS (
  SELECT i1 AS ant, i2 AS con, c AS nxy FROM s2 UNION ALL SELECT i2, i1, c FROM s2
  UNION ALL SELECT i1, i2 || ', ' || i3, c FROM s3 UNION ALL SELECT i2, i1 || ', ' || i3, c FROM s3
  UNION ALL SELECT i3, i1 || ', ' || i2, c FROM s3 UNION ALL SELECT i1 || ', ' || i2, i3, c FROM s3
  UNION ALL SELECT i1 || ', ' || i3, i2, c FROM s3 UNION ALL SELECT i2 || ', ' || i3, i1, c FROM s3),
scored AS (
  SELECT r.ant AS antecedents_str, r.con AS consequents_str, r.nxy / (SELECT n FROM nb) AS support,
         r.nxy / x.c AS confidence, r.nxy * (SELECT n FROM nb) / (x.c * y.c) AS lift
  FROM rules r JOIN itemsets x ON r.ant = x.k JOIN itemsets y ON r.con = y.k)"""

_RULES_SELECT = """
SELECT antecedents_str, consequents_str, ROUND(support, 8) AS support, ROUND(confidence, 8) AS confidence,
       ROUND(lift, 8) AS lift FROM scored WHERE lift >= 1.1"""


def _panel_sql(body: str, s: float = PANEL_SUPPORT) -> str:
    return q(",\n" + _THR + ",\n" + _PANEL_ACT + ",\n" + _itemsets_ctes(s) + body)


def _order_sql(body: str, s: float = ORDER_SUPPORT) -> str:
    return "WITH " + _ORDER_ACT + ",\n" + _itemsets_ctes(s) + body


def panel_baskets(spark, sf_dir):
    return J.baskets_from_panel(panel(spark, sf_dir))


def order_baskets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    li = t.lineitem.select("l_orderkey", "l_partkey")
    part = t.part.select("p_partkey", "p_brand")
    act = li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("b1"),
                                                               F.col("p_brand").alias("item")).distinct()
    n = act.select("b1").distinct().agg(F.count(F.lit(1)).alias("n_baskets"))
    return act, n


def panel_itemsets(spark, sf_dir):
    act, n = panel_baskets(spark, sf_dir)
    return J.frequent_itemsets(act, ["store", "week"], n, PANEL_SUPPORT, 3)


def order_itemsets(spark, sf_dir):
    act, n = order_baskets(spark, sf_dir)
    return J.frequent_itemsets(act, ["b1"], n, ORDER_SUPPORT, 3)


def _itemsets_out(df):
    return df.select(F.array_join("items", ", ").alias("itemset_str"), "size", "count", "support")


def _rules_out(df):
    return df.select("antecedents_str", "consequents_str", *[rnd(c, 8).alias(c) for c in
                                                            ("support", "confidence", "lift")])


@register("j1_activity_threshold", q(",\n" + _THR + "\nSELECT dept, ROUND(threshold, 6) AS threshold FROM thr"))
def j1_activity_threshold(spark, sf_dir):
    t = J.activity_threshold(panel(spark, sf_dir))
    return t.select("dept", rnd("threshold", 6).alias("threshold"))


@register("j2_j3_baskets", q(",\n" + _THR + ",\n" + _PANEL_ACT + """
SELECT b1 AS store, b2 AS week, COUNT(*) AS basket_size FROM act GROUP BY b1, b2"""))
def j2_j3_baskets(spark, sf_dir):
    act, _ = panel_baskets(spark, sf_dir)
    return act.groupBy("store", "week").agg(F.count(F.lit(1)).alias("basket_size"))


@register("j4_frequent_itemsets", _panel_sql(_ITEMSETS_SELECT))
def j4_frequent_itemsets(spark, sf_dir):
    return _itemsets_out(panel_itemsets(spark, sf_dir))


@register("j4_frequent_itemsets_orders", _order_sql(_ITEMSETS_SELECT))
def j4_frequent_itemsets_orders(spark, sf_dir):
    """True transaction baskets: order x part brand, support 0.2 %, up to triples."""
    return _itemsets_out(order_itemsets(spark, sf_dir))


@register("j5_association_rules", _panel_sql(",\n" + _RULES_CTE + _RULES_SELECT))
def j5_association_rules(spark, sf_dir):
    return _rules_out(J.association_rules(panel_itemsets(spark, sf_dir), min_lift=1.1))


@register("j5_association_rules_orders", _order_sql(",\n" + _RULES_CTE + _RULES_SELECT))
def j5_association_rules_orders(spark, sf_dir):
    return _rules_out(J.association_rules(order_itemsets(spark, sf_dir), min_lift=1.1))


@register("j6_top_rules", _order_sql(",\n" + _RULES_CTE + """
SELECT antecedents_str, consequents_str, ROUND(support, 8) AS support, ROUND(confidence, 8) AS confidence,
       ROUND(lift, 8) AS lift FROM scored WHERE lift >= 1.1
ORDER BY lift DESC, support DESC, antecedents_str, consequents_str LIMIT 15"""))
def j6_top_rules(spark, sf_dir):
    return _rules_out(J.top_rules(J.association_rules(order_itemsets(spark, sf_dir)), 15))


@register("j7_rules_bubble", _order_sql(",\n" + _RULES_CTE + """
SELECT antecedents_str, consequents_str, ROUND(confidence, 8) AS confidence, ROUND(lift, 8) AS lift,
       ROUND(support, 8) AS support FROM scored WHERE lift >= 1.1
ORDER BY antecedents_str, consequents_str LIMIT 80"""))
def j7_rules_bubble(spark, sf_dir):
    b = J.rules_bubble(J.association_rules(order_itemsets(spark, sf_dir)), 80)
    return b.select("antecedents_str", "consequents_str", *[rnd(c, 8).alias(c) for c in
                                                           ("confidence", "lift", "support")])


@register("d18_basket_matrix", q(",\n" + _THR + """
SELECT store, week, COALESCE(COLUMNS(* EXCLUDE (store, week)), 0) FROM (
  PIVOT (SELECT p.store, p.week, p.dept, CASE WHEN p.weekly_sales >= thr.threshold THEN 1 ELSE 0 END AS active
         FROM panel p JOIN thr ON p.dept = thr.dept)
  ON dept IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD') USING max(active) GROUP BY store, week)"""))
def d18_basket_matrix(spark, sf_dir):
    """Wide 0/1 basket matrix over the departments (small item lists only)."""
    from storecast.functions.scalar import distinct_levels, flag
    p = panel(spark, sf_dir)
    thr = J.activity_threshold(p)
    x = p.join(thr, "dept").withColumn("active", flag(F.col("weekly_sales") >= F.col("threshold")))
    return D.basket_matrix(x, ["store", "week"], "dept", "active", distinct_levels(p, "dept"))
