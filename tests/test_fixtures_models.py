"""Fixtures for segmentation, baskets, anomaly detectors and models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storecast.operators import anomaly as G
from storecast.operators import basket as J
from storecast.operators import segment as H

PTS = [(0, 0.0, 0.0, 0), (1, 0.0, 1.0, 0), (2, 1.0, 0.0, 0), (3, 10.0, 10.0, 1), (4, 10.0, 11.0, 1), (5, 30.0, 30.0, 2)]


@pytest.fixture()
def pts(spark):
    return spark.createDataFrame(PTS, "store int, a double, b double, lab int")


def test_silhouette(pts):
    assert H.silhouette(pts, ["a", "b"], "lab").first()["silhouette"] == pytest.approx(0.76896892, abs=1e-8)


def test_silhouette_blocks_agree(pts):
    s = H.silhouette(pts, ["a", "b"], "lab", block_rows=2).first()["silhouette"]
    assert s == pytest.approx(0.76896892, abs=1e-8)


def test_davies_bouldin(pts):
    assert H.davies_bouldin(pts, ["a", "b"], "lab").first()["davies_bouldin"] == pytest.approx(0.06080831, abs=1e-8)


def test_dbscan(pts):
    out = {r["store"]: r["dbscan"] for r in H.dbscan(pts, ["a", "b"], 1.5, 3, block_rows=2).collect()}
    assert [out[i] for i in range(6)] == [0, 0, 0, -1, -1, -1]


def test_bisecting_hierarchy(pts):
    lab = {r["store"]: r["bisect"] for r in H.bisecting(pts, ["a", "b"], 3).collect()}
    assert len(lab) == 6 and len(set(lab.values())) == 3
    table = [(r["k"], r["sizes"], r["within"]) for r in H.split_table(pts, ["a", "b"], 3).orderBy("k").collect()]
    assert [t[0] for t in table] == [1, 2, 3] and all(sum(t[1]) == 6 and len(t[1]) == t[0] for t in table)
    assert table[0][2] > table[1][2] > table[2][2]


def test_null_features_stay(spark):
    rows = [(0, 0.0, 1.0), (1, 0.1, None), (2, 9.0, 1.0), (3, None, float("nan"))]
    df = spark.createDataFrame(rows, "store int, a double, b double")
    lab, _ = H.kmeans(df, ["a", "b"], 2, n_init=1)
    assert lab.count() == 4 and lab.columns == ["store", "a", "b", "cluster"]


def test_dbscan_long_chain(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(300)] + [(999, 5000.0)], "store int, x double")
    out = {r["store"]: r["dbscan"] for r in H.dbscan(df, ["x"], 1.0, 3).collect()}
    assert out.pop(999) == -1 and set(out.values()) == {0}


def test_quantiles_keep_the_null_group(spark):
    from storecast.operators import explore, order
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 10.0), (None, 20.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in order.quantiles(df, "v", [0.5], by=["g"], names=["m"]).collect()}
    assert got == {"a": 2.0, None: 15.0}
    assert {r["g"]: r["n"] for r in explore.box_stats(df, "g", "v").collect()} == {"a": 2, None: 2}
    zero = spark.createDataFrame([(1, 2.0), (0, 0.0)], "f int, v double")
    assert explore.lift(zero, "f", "v").first()["lift"] is None


def test_rules_with_the_separator_in_an_item(spark):
    rows = [(i, x) for i in range(4) for x in ("a", "b", "a, b")]
    its = J.frequent_itemsets(spark.createDataFrame(rows, "b int, item string"), ["b"], spark.createDataFrame([(4,)], "n_baskets long"), 0.5, 3)
    rules = J.association_rules(its, min_lift=0.0).collect()
    assert len({(tuple(r["antecedents"]), tuple(r["consequents"])) for r in rules}) == len(rules) == 12


def test_basket_fixture(spark):
    baskets = [{1, 2, 3}, {1, 2}, {1, 3}, {2, 3}, {1, 2, 3}]
    rows = [(i, str(it)) for i, b in enumerate(baskets) for it in b]
    long = spark.createDataFrame(rows, "b int, item string")
    n = spark.createDataFrame([(5,)], "n_baskets long")
    its = J.frequent_itemsets(long, ["b"], n, 0.1, 3)
    sup = {", ".join(r["items"]): r["support"] for r in its.collect()}
    assert sup["1"] == pytest.approx(0.8) and sup["1, 2"] == pytest.approx(0.6) and sup["1, 2, 3"] == pytest.approx(0.4)
    rules = {(r["antecedents_str"], r["consequents_str"]): r for r in J.association_rules(its, min_lift=0.0).collect()}
    assert rules[("1", "2")]["confidence"] == pytest.approx(0.75)
    assert rules[("1", "2")]["lift"] == pytest.approx(0.9375)
    assert rules[("1", "2, 3")]["confidence"] == pytest.approx(0.5)
    assert rules[("1", "2, 3")]["lift"] == pytest.approx(0.5 / 0.6)


def test_c_factor():
    assert G.c_factor(256) == pytest.approx(10.24477092, abs=1e-8)


def test_isolation_forest_finds_planted_outlier(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (2000, 2)))]
    rows.append((9999, 12.0, -12.0))
    df = spark.createDataFrame(rows, "k long, x double, y double")
    forest = G.fit_isolation_forest(df, ["x", "y"], ["k"], trees=50, psi=128, seed=1)
    sc = G.score_isolation_forest(df, forest, ["x", "y"])
    top = sc.orderBy(F.col("if_score").desc()).first()
    assert top["k"] == 9999 and 0.5 < top["if_score"] <= 1.0
    again = G.score_isolation_forest(df, G.fit_isolation_forest(df, ["x", "y"], ["k"], trees=50, psi=128, seed=1), ["x", "y"])
    assert again.where("k = 9999").first()["if_score"] == pytest.approx(top["if_score"])


def _brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, axis=1)[:, :k]
    kd = np.take_along_axis(d, nn, 1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, nn, 1), kd[nn])
    lrd = 1.0 / (reach.mean(1) + 1e-10)
    return lrd[nn].mean(1) / lrd


def test_lof_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 2))
    x[0] = [6, 6]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "_id long, a double, b double")
    neigh = G.knn(df, ["a", "b"], 10, block_rows=64)
    got = {r["_id"]: r["lof"] for r in G.lof_scores(neigh, 10).collect()}
    exp = _brute_lof(x, 10)
    assert np.allclose([got[i] for i in range(300)], exp, rtol=1e-6)
    assert max(got, key=got.get) == 0


def test_stl_flags_spike():
    n = 300
    t = np.arange(n)
    y = 100 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 52) + np.random.default_rng(0).normal(0, 1, n)
    y[150] += 60
    _, season, r = G.stl(y, 52)
    z = (r - r.mean()) / r.std(ddof=1)
    assert int(np.argmax(np.abs(z))) == 150 and abs(z[150]) > 3
    assert 15 < season.max() < 25


def test_ridge_matches_closed_form(spark):
    from storecast.operators import models as M
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) * [1, 10, 100] + [5, -3, 50]
    y = x @ [2.0, -0.5, 0.03] + rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(v)) for (a, b, c), v in zip(x, y)],
                               "a double, b double, c double, weekly_sales double")
    m = M.fit_ridge(df, ["a", "b", "c"], 10.0)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 10.0 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(m.beta, beta, rtol=1e-8)
    pred = np.array([r["prediction"] for r in m.transform(df).collect()])
    assert np.allclose(pred, y.mean() + z @ beta, rtol=1e-8)


