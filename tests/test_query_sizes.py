"""Registered model queries run at the sizes of the survey; cheap fits stand in for the models here."""

import inspect

import pytest

import __spark_entry__  # noqa: F401  (registers every query)
from pyspark.sql import functions as F

from storecast.operators import models as M
from storecast.operators import planning as K
from storecast.operators import segment as H
from storecast.plans import forecast_queries as FQ
from storecast.plans import planning_queries as PQ
from storecast.plans.registry import QUERIES
from tests.conftest import SF001


@pytest.fixture
def fits(monkeypatch):
    """Arguments of each fit, search and KMeans, defaults filled in."""
    seen = []

    def watched(module, name, result):
        real = getattr(module, name)

        def call(*args, **kw):
            bound = inspect.signature(real).bind(*args, **kw)
            bound.apply_defaults()
            seen.append((name, dict(bound.arguments)))
            return result(real, bound.arguments)
        monkeypatch.setattr(module, name, call)

    for name in ("fit_forest", "fit_boosted"):
        watched(M, name, lambda real, a: M.fit_linear(a["train"], a["feats"]))
    watched(M, "random_search", lambda real, a: ({k: v[-1] for k, v in a["grid"].items()}, None))
    watched(H, "kmeans", lambda real, a: real(**{**a, "n_init": 1}))
    return seen


def of(seen, name, *keys):
    return [tuple(a[k] for k in keys) for n, a in seen if n == name]


def test_leaderboard_and_best_model(spark, fits):
    names = {"linear", "ridge_tuned", "random_forest", "random_forest_tuned", "boosted_trees", "boosted_trees_tuned"}
    assert {r.model for r in QUERIES["i1_i9_leaderboard"](spark, SF001).collect()} == names | {"seasonal_naive"}
    assert of(fits, "fit_forest", "trees", "depth") == [(200, 18), (300, 24)]
    assert of(fits, "fit_boosted", "rounds", "depth", "lr") == [(600, 8, 0.05), (1000, 10, 0.08)]
    sizes = {a["kind"]: (a["n_iter"], a["k"], len(a["grid"])) for n, a in fits if n == "random_search"}
    assert sizes == {"forest": (6, 3, 4), "boosted": (6, 3, 5)}


def test_ridge_can_be_saved(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i + i % 3) for i in range(20)], "a double, b double, weekly_sales double")
    model = M.fit_ridge(rows, ["a", "b"], 1.0)
    model.pipeline().write().save(f"{tmp_path}/m")
    again = M.PipelineModel.load(f"{tmp_path}/m").transform(rows).collect()
    assert [r.prediction for r in again] == pytest.approx([r.prediction for r in model.transform(rows).collect()])


def test_restarts(spark, fits):
    QUERIES["h3_kmeans_labels"](spark, SF001)
    assert of(fits, "kmeans", "n_init") == [(20,)] * 7 + [(30,)]
    fits.clear()
    QUERIES["k11_cluster_stability"](spark, SF001)
    assert of(fits, "kmeans", "n_init") == [(30,)] * 2


def test_a_model_for_each_cluster(spark, monkeypatch):
    labels = PQ.store_vectors(spark, SF001).select("store", (F.col("store") % 4).alias("cluster"))
    monkeypatch.setattr(PQ, "h3_kmeans_labels", lambda *_: labels)
    _, test = FQ.frames(spark, SF001)
    want = {f"linear_cluster_{r.c}": r.n for r in test.groupBy((F.col("store") % 4).alias("c")).agg(F.count("*").alias("n")).collect()}
    assert {r.model: r.n for r in QUERIES["k15_per_cluster_models"](spark, SF001).collect()} == want and len(want) > 1


def test_weights_come_from_the_stl_flag(spark, monkeypatch):
    flags = FQ.panel(spark, SF001).select("store", "dept", "week", F.when(F.month("week") == 3, 1).otherwise(0).alias("stl_anomaly"))
    monkeypatch.setattr(PQ, "g5_stl_anomalies", lambda *_: flags.where("store > 1"))
    weights, real = [], K.sample_weights
    monkeypatch.setattr(PQ.K, "sample_weights", lambda *a: weights.append(real(*a)) or weights[0])
    assert QUERIES["k16_k17_fallback_and_weights"](spark, SF001).count() == 2
    assert weights[0].where((F.col("w") < 1) != ((F.month("week") == 3) & (F.col("store") > 1))).count() == 0


def test_the_report_holds_the_whole_leaderboard(spark, monkeypatch):
    monkeypatch.setattr(FQ, "fitted_models", lambda train: {"linear": M.fit_linear(train, FQ.FEATS), "other": M.fit_linear(train, ["lag_52"])})
    report = QUERIES["a5_a6_report_csv"](spark, SF001).where("report = 'leaderboard'").collect()
    assert {r.key for r in report} == {"linear", "other", "seasonal_naive"}


def test_restarts_run_on_as_many_tasks_as_the_rows_need(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    tasks, real = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, x: tasks.append(x.rdd.getNumPartitions()) or real(self, x))
    rows = spark.range(30, numPartitions=16).select(F.col("id").alias("store"), (F.col("id") % 3).cast("double").alias("a"), (F.col("id") * 0.01).alias("b"))
    labels = H.kmeans(rows, ["a", "b"], 3, n_init=2)[0].collect()
    assert tasks == [1, 1]
    assert len(labels) == 30 and len({(r.a, r.cluster) for r in labels}) == 3
    tasks.clear()
    monkeypatch.setattr(H, "KMEANS_ROWS", 10)
    H.kmeans(rows, ["a", "b"], 3, n_init=1)
    assert tasks == [3]


def test_the_model_frame_is_kept_on_few_tasks(spark, monkeypatch):
    rows = spark.range(5000, numPartitions=64).select("id", F.date_add(F.lit("2020-01-06").cast("date"), (F.col("id") % 100 * 7).cast("int")).alias("week"))
    monkeypatch.setattr(FQ, "panel", lambda *_: None)
    monkeypatch.setattr(FQ.M, "model_frame", lambda _: rows)
    train, test = FQ.frames(spark, "")
    assert (train.rdd.getNumPartitions(), test.rdd.getNumPartitions()) == (3, 3)
    assert sorted(r.id for part in (train, test) for r in part.collect()) == list(range(5000))


def test_ridge_ignores_a_column_that_is_constant_in_the_fold(spark):
    rows = spark.range(4000, numPartitions=5).select(
        F.sin("id").alias("a"), F.when(F.col("id") < 2000, 0.0).otherwise(F.col("id") * 37.7).alias("m"), (3 * F.sin("id") + F.col("id") % 7).alias("weekly_sales"),
        (F.col("id") >= 2000).cast("int").alias("block"))
    parts = M.gram_blocks(rows, ["a", "m"], "block")
    early = M.ridge_from_moments([p for p in parts if p["block"] == 0], ["a", "m"], 0.1)
    assert early.beta[1] == 0.0 and early.std[1] == 1.0 and early.beta[0] != 0.0
    alone = M.ridge_from_moments(M.gram_blocks(rows.where("block = 0"), ["a"]), ["a"], 0.1)
    assert early.beta[0] == pytest.approx(alone.beta[0])
    assert all(M.ridge_from_moments(parts, ["a", "m"], 0.1).beta)
