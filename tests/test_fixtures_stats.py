"""Hand fixtures with exact answers (statistics, metrics, fills, windows)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storecast.functions import distributions as dist
from storecast.operators import forecast as fc
from storecast.operators import order, stats, windows, wrangle
from storecast.functions import scalar

X = [1, 2, 2, 4]
Y = [2, 3, 5, 5, 7]


@pytest.fixture()
def two(spark):
    rows = [(float(v), 1) for v in X] + [(float(v), 0) for v in Y]
    return spark.createDataFrame(rows, "v double, g int")


def test_welch(two):
    r = stats.welch_t(two, "v", "g").first()
    assert r["t"] == pytest.approx(-1.99981975, abs=1e-7)
    assert r["df"] == pytest.approx(6.79430514, abs=1e-7)
    assert 0.5 < r["p_value"] < 1.0


def test_anova(two):
    r = stats.anova(two, "v", "g").first()
    assert r["f"] == pytest.approx(3.60428850, abs=1e-7)
    assert r["df_between"] == 1 and r["df_within"] == 7


def test_kruskal(two):
    r = stats.kruskal(two, "v", "g").first()
    assert r["h"] == pytest.approx(3.06782609, abs=1e-7)
    assert r["p_value"] == pytest.approx(0.07985626, abs=1e-7)


def test_mann_whitney(two):
    r = stats.mann_whitney(two, "v", "g", "greater").first()
    assert r["u"] == pytest.approx(3.0)
    assert r["z"] == pytest.approx(-1.87662973, abs=1e-7)
    assert r["p_value"] == pytest.approx(0.96971557, abs=1e-7)


def test_distribution_tails(spark):
    def value(f, *args):
        return spark.range(1).select(f(*map(F.lit, args))).first()[0]
    for z in (-8.0, -1.5, 0.0, 0.3, 2.0, 6.0, 20.0):
        assert value(dist.norm_sf, z) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-9)
    assert value(dist.t_sf, 2.0, 10.0) == pytest.approx(0.03669401738537, rel=1e-9)
    assert value(dist.t_sf, -1.0, 1.0) == pytest.approx(0.75, rel=1e-9)
    assert value(dist.t_sf, 2.0, 2.0) == pytest.approx(0.5 - 2 / (2 * math.sqrt(6)), rel=1e-9)
    assert value(dist.t_sf, 2.5, 200.0) == pytest.approx(value(dist.t_sf, 2.5, 200.0001), rel=1e-6)
    assert value(dist.chi2_sf, 3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert value(dist.chi2_sf, 5.0, 2) == pytest.approx(math.exp(-2.5), rel=1e-12)
    assert value(dist.chi2_sf, 7.814727903, 3) == pytest.approx(0.05, abs=1e-8)
    assert value(dist.chi2_sf, 9.487729037, 4) == pytest.approx(0.05, abs=1e-8)
    assert value(dist.f_sf, 4.0, 2, 10) == pytest.approx(1.8 ** -5, rel=1e-9)
    assert value(dist.f_sf, 4.0, 1, 10) == pytest.approx(2 * value(dist.t_sf, 2.0, 10.0), rel=1e-9)
    assert value(dist.f_sf, 3.478049691, 4, 10) == pytest.approx(0.05, abs=1e-6)


def test_two_sided_p_is_at_most_one(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 1), (4.0, 0), (9.0, None)], "v double, g int")
    r = stats.mann_whitney(df, "v", "g", "two-sided").first()
    assert r["p_value"] == 1.0 and (r["n1"], r["n0"]) == (2, 2)


def test_metrics(spark):
    df = spark.createDataFrame([(10.0, 12.0, 0), (20.0, 15.0, 1), (30.0, 33.0, 0)], "y double, yhat double, is_holiday int")
    r = fc.metrics(df).first()
    assert r["wmae"] == pytest.approx(30 / 7)
    assert r["mae"] == pytest.approx(10 / 3)
    assert r["rmse"] == pytest.approx(3.55902608, abs=1e-8)
    assert r["r2"] == pytest.approx(0.81)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.normal(0, 10, 3000), 1)  # many ties
    grp = rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g int, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    got = {r["g"]: r for r in order.quantiles(df, "v", probs, by=["g"]).collect()}
    for g in range(3):
        exp = np.percentile(vals[grp == g], [p * 100 for p in probs])
        assert [got[g][f"q{int(round(p * 100)):02d}"] for p in probs] == pytest.approx(list(exp), abs=1e-9)
    glob = order.quantiles(df, "v", [0.5], names=["m"]).first()["m"]
    assert glob == pytest.approx(float(np.median(vals)))


def test_average_ranks_match_pandas(spark):
    import pandas as pd
    vals = [3.0, 1.0, 2.0, 2.0, 5.0, 3.0, 3.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r["v"]: r["rank"] for r in order.average_ranks(df, "v").collect()}
    exp = dict(zip(vals, pd.Series(vals).rank(method="average")))
    assert got == exp


def test_ffill_bfill(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, None), (2, 1, 7.0), (2, 2, None), (2, 3, None),
                                (3, 1, None), (3, 2, None)], "store int, week int, cpi double")
    out = wrangle.ffill_bfill(df, ["cpi"], ["store"], "week").orderBy("store", "week").collect()
    assert [r["cpi"] for r in out] == [5.0, 5.0, 5.0, 7.0, 7.0, 7.0, None, None]


def test_lags_and_rolls_do_not_leak(spark):
    rows = [("a", "x", i, float(i)) for i in range(1, 7)] + [("b", "x", i, float(9 + i)) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "store string, dept string, week int, weekly_sales double")
    df = windows.rolling_means(windows.lags(df, "weekly_sales", (1,)), "weekly_sales", (4,))
    a = [r["roll_4"] for r in df.where("store = 'a'").orderBy("week").collect()]
    b = df.where("store = 'b'").orderBy("week").collect()
    assert a == [None, None, None, None, 2.5, 3.5]
    assert [r["roll_4"] for r in b] == [None] * 4
    assert [r["lag_1"] for r in b] == [None, 10.0, 11.0, 12.0]


def test_interpolate(spark):
    import datetime as dt
    d0 = dt.date(2024, 1, 1)
    rows = [(1, "x", d0 + dt.timedelta(days=7 * i), v) for i, v in enumerate([2.0, None, None, 8.0])]
    rows += [(2, "x", d0 + dt.timedelta(days=7 * i), v) for i, v in enumerate([None, 1.0, None])]
    df = spark.createDataFrame(rows, "store int, dept string, week date, y double")
    out = windows.interpolate_linear(df, "y").orderBy("store", "week").collect()
    assert [r["y"] for r in out] == [2.0, 4.0, 6.0, 8.0, None, 1.0, 1.0]


def test_weekly_grid_fills_gaps(spark):
    import datetime as dt
    d0 = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, "x", d0, 1.0), (1, "x", d0 + dt.timedelta(days=21), 2.0)],
                               "store int, dept string, week date, y double")
    assert windows.weekly_grid(df).count() == 4


def test_one_hot_drop_first(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",)], "type string")
    out = scalar.one_hot_drop_first(df, "type", ["C", "A", "B"])
    assert out.columns == ["type", "type_B", "type_C"]
    assert [tuple(r)[1:] for r in out.orderBy("type").collect()] == [(0, 0), (1, 0), (0, 1)]


def test_sample_n_is_exact_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = wrangle.sample_n(df, 50, 7, ["k"])
    b = wrangle.sample_n(df.repartition(13), 50, 7, ["k"])
    assert a.count() == 50
    assert sorted(r["k"] for r in a.collect()) == sorted(r["k"] for r in b.collect())


def test_correlations_with_nulls_and_constants(spark):
    from storecast.operators import explore as D
    rows = [(1e6 + i, float(i % 7), float(i * i) if i % 3 else None, 5.0) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = {(r.a, r.b): r.r for r in D.corr_matrix(df, ["a", "b", "c", "k"]).collect()}
    want = df.agg(*[F.corr(x, y).alias(x + y) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))]).first()
    assert len(got) == 16 and got["a", "a"] == 1.0
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        assert got[x, y] == got[y, x] == pytest.approx(want[x + y], abs=1e-12)
    assert got["a", "k"] is None and got["k", "c"] is None
    flat = df.withColumn("b", F.when(F.col("c").isNotNull(), 0.1).otherwise(F.col("b")))  # constant where c is known
    assert {r.r for r in D.corr_matrix(flat, ["b", "c"]).collect() if r.a != r.b} == {None}


def test_cents_round_as_decimals_do(spark):
    from storecast.sources.panel import _amount, _cents
    values = [0.0, 0.01, 0.29, 1.005, 2.675, 33.335, 99999.99, 901.00, 0.004999, -1.25, -0.015, 1e7 + 0.07]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(_cents("v").alias("got"), (F.col("v").cast("decimal(12,2)") * 100).cast("long").alias("want"))
    assert all(r.got == r.want for r in df.collect())
    assert spark.range(1).select(_amount(F.lit(123456789), 4).alias("x")).first().x == 12345.6789
