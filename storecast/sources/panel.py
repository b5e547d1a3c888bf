"""A4 — build the store x dept x week panel from the test tables.

store = nation of the supplier (or customer), dept = part type,
week = Monday of the ship date. These three tables stand in for the
reference's sales, features and stores inputs; ``wrangled_panel``
then applies the reference's cleaning steps (C1, C2, C4, C5, C8, C9).

Scale notes: both fact aggregates are hash aggregates with map-side
partial aggregation, so a hot store/week only produces one partial row
per map task. The panel is unique on (store, dept, week) by
construction, which bounds every later per-series window to the
number of calendar weeks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storecast.operators.order import materialize
from storecast.session import ensure_checkpoint_dir
from storecast.sources.tables import Tables
from storecast.operators import wrangle

# Fixed values of the panel recipe (must equal the oracle SQL):
# holiday ISO weeks 6, 36, 47, 52; markdown launch week 1998-01-05;
# a line is a net return when l_returnflag = 'R' and l_discount >= 0.09.
HOLIDAY_WEEKS = (6, 36, 47, 52)
MARKDOWN_LAUNCH = "1998-01-05"
MARKDOWN_COLS = ["markdown1", "markdown2", "markdown3", "markdown4", "markdown5"]
PANEL_COLUMNS = ["store", "dept", "week", "weekly_sales", "is_holiday", "temperature", "fuel_price",
                 *MARKDOWN_COLS, "cpi", "unemployment", "type", "size", "total_markdown",
                 "year", "month", "week_of_year", "day"]


def _cents(c: str):
    """The unscaled number of ``CAST(c AS DECIMAL(12,2))`` as a long, so that sums stay primitive.

    Next to a whole number of cents rounding needs no decimal; any other value takes the cast.
    """
    cents = F.col(c) * 100
    whole = F.rint(cents)
    return F.when(F.abs(cents - whole) < 1e-6, whole.cast("long")).otherwise((F.col(c).cast("decimal(12,2)") * 100).cast("long"))


def _amount(total, digits: int):
    """A sum of whole units as a double: units / 10^digits, rounded once."""
    return (total.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-digits))).cast("double")


def _week(c: str):
    return F.date_trunc("week", F.col(c)).cast("date")


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over ``lineitem``: exact partial sums (whole cents) per (store, dept, week).

    Both the sales fact and the store-week features are re-aggregations
    of this table. ``dept`` is NULL for lines whose part is unknown: they
    count for the features but not for the sales panel, as in the
    recipe's inner join.
    """
    t = Tables(spark, sf_dir)
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                           "l_returnflag", "l_discount", "l_tax", "l_shipdate")
    sup = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("store"))
    part = t.part.select("p_partkey", F.col("p_type").alias("dept"))
    sign = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09), F.lit(-1)).otherwise(F.lit(1))
    hol = F.when(F.weekofyear("l_shipdate").isin(*HOLIDAY_WEEKS), F.lit(1)).otherwise(F.lit(0))
    disc = _cents("l_extendedprice") * _cents("l_discount")  # in units of 10^-4
    md = [F.sum(F.when(F.col("l_linenumber") == i, disc)).alias(f"md{i}") for i in range(1, 6)]
    return (
        li.join(sup, li.l_suppkey == sup.s_suppkey)
        .join(part, li.l_partkey == part.p_partkey, "left")
        .groupBy("store", "dept", _week("l_shipdate").alias("week"))
        .agg(F.sum(sign * _cents("l_extendedprice")).alias("sales"), F.max(hol).alias("hol"),
             F.count(F.lit(1)).alias("n"), F.sum(_cents("l_quantity")).alias("q"),
             F.sum(_cents("l_tax")).alias("tx"), *md)
    )


def panel_sales(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Fact table: (store, dept, week, weekly_sales, is_holiday)."""
    f = facts if facts is not None else line_facts(spark, sf_dir)
    return f.where(F.col("dept").isNotNull()).select(
        "store", "dept", "week", _amount(F.col("sales"), 2).alias("weekly_sales"), F.col("hol").alias("is_holiday"))


def panel_features(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Store-week features with natural gaps (cpi/unemployment) and pre-launch nulls (markdowns)."""
    t = Tables(spark, sf_dir)
    f = facts if facts is not None else line_facts(spark, sf_dir)
    lagg = f.groupBy("store", "week").agg(
        F.sum("n").alias("n"), _amount(F.sum("q"), 2).alias("q"), _amount(F.sum("tx"), 2).alias("tx"),
        *[_amount(F.sum(f"md{i}"), 4).alias(f"md{i}") for i in range(1, 6)])
    o = t.orders.select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("store"))
    oagg = (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy("store", _week("o_orderdate").alias("week"))
        .agg(F.count(F.lit(1)).alias("on"),
             _amount(F.sum(_cents("o_totalprice")), 2).alias("tp"),
             F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("nf"))
    )
    launched = F.col("week") >= F.lit(MARKDOWN_LAUNCH).cast("date")
    return (
        lagg.join(oagg, ["store", "week"], "left")
        .select("store", "week",
                (F.col("q") / F.col("n")).alias("temperature"),
                (F.col("tx") / F.col("n")).alias("fuel_price"),
                *[F.when(launched, F.col(f"md{i}")).alias(f"markdown{i}") for i in range(1, 6)],
                (F.col("tp") / F.col("on")).alias("cpi"),
                (F.lit(100.0) * F.col("nf") / F.col("on")).alias("unemployment"))
    )


def panel_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store dimension: (store, type, size)."""
    t = Tables(spark, sf_dir)
    nation = t.nation.select("n_nationkey")
    sup = t.supplier.select("s_suppkey", "s_nationkey")
    k = F.col("n_nationkey")
    typ = F.when(k % 5 < 2, "A").when(k % 5 < 4, "B").otherwise("C")
    return (
        nation.join(sup, nation.n_nationkey == sup.s_nationkey, "left")
        .groupBy("n_nationkey")
        .agg(F.count("s_suppkey").alias("_n"))
        .select(k.alias("store"), typ.alias("type"),
                (F.lit(1000) * F.col("_n") + F.lit(10) * k).cast("bigint").alias("size"))
    )


def wrangled_panel(spark: SparkSession, sf_dir: str, validate: bool = False) -> DataFrame:
    """Sales + cleaned features + stores + total markdown + calendar parts.

    C1 markdown nulls -> 0; C2 cpi/unemployment forward then backward
    filled within store; C4/C5 left many-to-one joins; C8 total
    markdown; C9 year, month, ISO week, day.
    """
    # written once (one row per store, department and week), so both branches share one scan of the line items
    ensure_checkpoint_dir(spark)
    facts = materialize(line_facts(spark, sf_dir))
    feats = panel_features(spark, sf_dir, facts)
    feats = wrangle.fill_zero(feats, MARKDOWN_COLS)
    feats = wrangle.ffill_bfill(feats, ["cpi", "unemployment"], by=["store"], order="week")
    sales = panel_sales(spark, sf_dir, facts)
    stores = panel_stores(spark, sf_dir)
    df = wrangle.left_join_many_to_one(sales, feats, ["store", "week"], validate=validate)
    df = wrangle.left_join_many_to_one(df, stores, ["store"], validate=validate)
    df = wrangle.row_sum(df, MARKDOWN_COLS, "total_markdown")
    return wrangle.calendar(df, "week").select(*PANEL_COLUMNS)
