"""Tree ensembles: splits against brute force, known fits, saving and scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storecast.operators import models as M
from storecast.operators import trees as T


def _data(seed, n=300, p=4, n_bins=9):
    rng = np.random.default_rng(seed)
    return rng.integers(0, n_bins, (p, n)).astype(np.uint8), rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng


@pytest.mark.parametrize("weighted", [True, False])
def test_splits_equal_brute_force(weighted):
    x, t, w, rng = _data(1)
    w = w + 1 if weighted else None
    m, least, penalty, n_bins = 12, 3, 0.5, 9
    node = rng.integers(0, m, x.shape[1])
    allowed = rng.random((m, len(x))) < 0.7
    ones = np.ones(x.shape[1]) if w is None else w
    counts, sums = np.bincount(node, ones, m), np.bincount(node, ones * t, m)
    order = np.argsort(x, axis=1, kind="stable")
    order = np.stack([o[np.argsort(node[o], kind="stable")] for o in order])
    shared = (node, m, w, t, sums, counts, allowed, n_bins, least, penalty)
    for found in (T._by_histogram(x, *shared), T._by_order(x, order, *shared)):
        for k in range(m):
            best = -np.inf
            for f in np.flatnonzero(allowed[k]):
                for b in range(n_bins - 1):
                    left = (node == k) & (x[f] <= b)
                    right = (node == k) & (x[f] > b)
                    if ones[left].sum() >= least and ones[right].sum() >= least:
                        s = [(ones * t)[side].sum() ** 2 / (ones[side].sum() + penalty) for side in (left, right, node == k)]
                        best = max(best, s[0] + s[1] - s[2])
            assert found.gain[k] == pytest.approx(best)


def test_a_deep_tree_fits_its_rows():
    x, t, _, _ = _data(2, n=200, p=6, n_bins=40)
    tree = T.grow(x, t, np.ones(200), 30, 40)
    assert np.allclose(tree.value[tree.leaves(x)], t)
    stump = T.grow(x, t, np.ones(200), 1, 40, least=50)
    leaf = stump.leaves(x)
    assert len(stump.feature) == 3 and min(np.bincount(leaf)[1:]) >= 50
    assert np.allclose(stump.value[1:], [t[leaf == i].mean() for i in (1, 2)])


def test_weights_repeat_rows():
    x, t, w, _ = _data(3, n=80)
    twice = np.repeat(np.arange(80), w.astype(int))
    a, b = T.grow(x, t, w, 4, 9), T.grow(x[:, twice], t[twice], np.ones(len(twice)), 4, 9)
    assert np.array_equal(a.feature, b.feature) and np.allclose(a.value, b.value)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(0, 600, 1, 4).select(F.col("id").alias("store"), F.lit("d").alias("dept"), F.expr("date_add(DATE'2020-01-06', CAST(id div 10 AS INT) * 7)").alias("week"),
                                          (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit(0).alias("is_holiday"))
    return df.withColumn("weekly_sales", F.when(F.col("a") > 4, 100.0).otherwise(10.0) + F.col("b"))


def test_models_learn_save_and_load(spark, rows, tmp_path):
    for fit, more in ((M.fit_forest, {"trees": 12, "depth": 6}), (M.fit_boosted, {"rounds": 60, "depth": 3, "lr": 0.3})):
        model = fit(rows, ["a", "b"], **more)
        scored = model.transform(rows).select("store", "weekly_sales", "prediction").collect()
        assert np.mean([abs(r.weekly_sales - r.prediction) for r in scored]) < 1.0
        assert model.importances.sum() == pytest.approx(1.0) and model.importances[0] > 0.9
        path = f"{tmp_path}/{fit.__name__}"
        M.save_model(model, {"model_name": "m"}, path)
        again = {r.store: r.predicted for r in M.load_and_score(path, rows, 5).collect()}
        assert len(again) == 5 and all(again[r.store] == round(r.prediction, 2) for r in scored if r.store in again)


def test_search_prefers_the_better_draw(rows):
    best, table = M.random_search(rows, ["a", "b"], "boosted", {"rounds": [1, 40], "depth": [3], "lr": [0.3]}, n_iter=2)
    assert best["rounds"] == 40 and table.count() == 2
    best, table = M.random_search(rows, ["a", "b"], "forest", {"trees": [60], "depth": [1, 6], "max_features": ["all"]}, n_iter=2)
    assert best["depth"] == 6 and min(r.cv_rmse for r in table.collect()) < 3


def test_the_sample_is_bounded_and_stable(rows):
    a, b = (T.binned_sample(rows.repartition(n), ["a", "b"], "weekly_sales", rows=200) for n in (2, 5))
    assert 120 < len(a.label) < 280 and np.array_equal(a.label, b.label) and np.array_equal(a.bins, b.bins)
    assert len(T.binned_sample(rows, ["a"], "weekly_sales").label) == 600


def test_missing_values_and_empty_rows(spark, rows):
    holes = rows.withColumn("b", F.when(F.col("store") % 3 == 0, F.lit(None)).otherwise(F.col("b")))
    model = M.fit_forest(holes, ["a", "b"], trees=3, depth=4)
    assert model.transform(holes).where("prediction is null or isnan(prediction)").count() == 0
    empty = M.fit_boosted(rows.limit(0), ["a", "b"], rounds=2)
    assert {r.prediction for r in empty.transform(rows).collect()} == {0.0}


def _plain(spark, n):
    """Rows with a heavy tail, so that few of them decide a mean."""
    df = spark.range(0, n, 1, 4).select(F.col("id").alias("store"), F.expr("date_add(DATE'2020-01-06', CAST(id % 40 AS INT) * 7)").alias("week"), (F.col("id") % 9).cast("double").alias("a"))
    return df.withColumn("weekly_sales", F.when(F.col("store") % 10_007 == 0, 1e6 + F.col("store")).otherwise(F.col("a")))


def test_models_are_fitted_on_all_rows(spark):
    rows = _plain(spark, 230_000)
    y = np.array([r[0] for r in rows.select("weekly_sales").collect()])
    assert M.fit_boosted(rows, ["a"], rounds=1, depth=1).start == pytest.approx(y.mean(), rel=1e-9)
    assert T.binned(rows, ["a"], "weekly_sales").rows == len(y)


@pytest.mark.parametrize("kind, params", [("boosted", {"rounds": [1], "depth": [0], "lr": [0.0]}), ("forest", {"trees": [1], "depth": [0]})])
def test_searches_score_all_rows(spark, kind, params):
    rows = _plain(spark, 90_000)
    _, table = M.random_search(rows, ["a"], kind, params, n_iter=1)
    day, y = (np.array(x) for x in zip(*[(r.week.toordinal(), r.weekly_sales) for r in rows.select("week", "weekly_sales").collect()]))
    folds = {r.week.toordinal(): r.fold_test for r in M.fc.time_folds(rows, 3).collect()}
    fold = np.array([folds[d] for d in day])
    want = np.mean([np.sqrt(((y[fold == k] - y[fold < k].mean()) ** 2).mean()) for k in (1, 2, 3)])
    # a forest's tree is grown on a bootstrap draw of the rows, which moves its mean a little
    assert table.first().cv_rmse == pytest.approx(want, rel=1e-9 if kind == "boosted" else 1e-3)


def test_edges_are_the_exact_quantiles_of_all_rows(spark):
    rng = np.random.default_rng(5)
    values = np.stack([rng.normal(size=3000), rng.integers(0, 5, 3000), np.full(3000, np.nan), np.where(rng.random(3000) < 0.3, np.nan, rng.random(3000) ** 9)], 1)
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(values)], "a double, b double, c double, d double").repartition(7)
    for max_bins in (64, 7):
        for column, found in zip(values.T, T.bin_edges(df, max_bins)):
            own = column[~np.isnan(column)]
            want = np.unique(np.quantile(own, np.arange(1, max_bins) / max_bins, method="inverted_cdf")) if len(own) else np.zeros(0)
            assert np.array_equal(found, want)


@pytest.mark.parametrize("limit", [40, 150, 299])
def test_trees_by_slices_equal_trees_in_memory(monkeypatch, limit):
    x, t, w, _ = _data(6, n=700, p=5, n_bins=20)
    t = np.round(t * 100)
    for depth, least, penalty, features in ((0, 1, 0.0, None), (3, 5, 1.0, np.array([1, 3, 4])), (12, 1, 0.0, None)):
        whole = T.grow(x, t, w, depth, 20, least, penalty, features)
        with monkeypatch.context() as m:
            m.setattr(T, "ROWS_IN_MEMORY", limit)
            m.setattr(T, "BYTES_IN_MEMORY", 0)
            parts = T.grow(x, t, w, depth, 20, least, penalty, features)
        assert len(parts.feature) == len(whole.feature) and np.allclose(np.sort(parts.gain), np.sort(whole.gain))
        assert np.array_equal(parts.value[parts.leaves(x)], whole.value[whole.leaves(x)])


def test_forests_and_boosting_by_slices(monkeypatch):
    x, _, _, _ = _data(7, n=1000, p=3, n_bins=12)
    y = np.where(x[0] > 5, 50.0, 0.0) + x[1]

    def errors():
        start, trees = T.grow_boosted(x, y, 12, 1, rounds=80, depth=4, lr=0.2)
        forest = list(T.grow_forest(x, y, 12, range(8), depth=8, max_features="0.7"))
        return np.array([np.abs(start + sum(t.value[t.leaves(x)] for t in trees) - y).mean(), np.abs(sum(t.value[t.leaves(x)] for t in forest) / 8 - y).mean()])

    whole = errors()
    monkeypatch.setattr(T, "ROWS_IN_MEMORY", 150)
    monkeypatch.setattr(T, "BYTES_IN_MEMORY", 0)
    assert whole.max() < 1.0 and (errors() < 1.3 * whole + 0.1).all()
