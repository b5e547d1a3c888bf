"""Registered queries for forecasting models (I1-I13, A7, A8), at the reference's sizes: 200 x 18 forest,
600 x 8 boosting, searches of 6 draws on 3 folds with the best draw fitted again on all training rows."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from storecast.operators import features as fe
from storecast.operators import forecast as fc
from storecast.operators import models as M
from storecast.operators import order
from storecast.plans import sql_blocks as S
from storecast.plans.explore_queries import panel
from storecast.plans.registry import register

FEATS = fe.FORECAST_FEATURES
FOREST_GRID = {"trees": [150, 300], "depth": [12, 18, 24], "min_instances": [1, 5], "max_features": ["sqrt", "0.5"]}
BOOSTED_GRID = {"rounds": [400, 700, 1000], "depth": [6, 8, 10], "lr": [0.03, 0.05, 0.08], "subsample": [0.8, 0.9, 1.0],
                "colsample": [0.7, 0.9]}


def frames(spark, sf_dir):
    return fe.temporal_split(order.kept(M.model_frame(panel(spark, sf_dir))))


@register("i1_linear_one_feature", S.with_ctes(S.MODEL + [
    "coef AS (SELECT regr_slope(weekly_sales, lag_52) AS b, regr_intercept(weekly_sales, lag_52) AS a FROM train_rows)",
    "pred AS (SELECT weekly_sales AS y, a + b * lag_52 AS yhat, is_holiday FROM test_rows, coef)"], """
SELECT 'linear_lag52' AS model, """ + S.metrics_sql() + " FROM pred"))
def i1_linear_one_feature(spark, sf_dir):
    """OLS of sales on lag_52 fitted on the training split, scored on the test split."""
    train, test = frames(spark, sf_dir)
    m = M.fit_linear(train, ["lag_52"])
    return fc.metrics(M.predict(m, test, "linear_lag52"), ["model"], digits=2)


def fitted_models(train) -> dict:
    """The six models of the leaderboard by name; the tuned ones are the best draws, fitted on all training rows.

    The fits don't depend on each other: their jobs are submitted together and share the executors.
    """
    def tuned(kind, grid, fit):
        return fit(train, FEATS, **M.random_search(train, FEATS, kind, grid)[0])

    jobs = {"linear": lambda: M.fit_linear(train, FEATS),
            "ridge_tuned": lambda: M.fit_ridge(train, FEATS, M.ridge_search(train, FEATS, (0.1, 1.0, 10.0, 100.0), k=4)[0]).pipeline(),
            "boosted_trees": lambda: M.fit_boosted(train, FEATS), "random_forest": lambda: M.fit_forest(train, FEATS),
            "boosted_trees_tuned": lambda: tuned("boosted", BOOSTED_GRID, M.fit_boosted), "random_forest_tuned": lambda: tuned("forest", FOREST_GRID, M.fit_forest)}
    train.count()  # cached before the jobs start
    with ThreadPoolExecutor(len(jobs)) as pool:
        futures = {name: pool.submit(inheritable_thread_target(train.sparkSession)(job)) for name, job in jobs.items()}
        found = {name: future.result() for name, future in futures.items()}
    return {name: found[name] for name in ("linear", "ridge_tuned", "random_forest", "random_forest_tuned", "boosted_trees", "boosted_trees_tuned")}


@register("i1_i9_leaderboard")
def i1_i9_leaderboard(spark, sf_dir):
    """Leaderboard: linear, tuned ridge, forest and boosted trees (as given and tuned) and the seasonal-naive baseline."""
    train, test = frames(spark, sf_dir)
    return fc.leaderboard([fc.seasonal_naive(test), *[M.predict(m, test, n) for n, m in fitted_models(train).items()]])


@register("i2_ridge_search")
def i2_ridge_search(spark, sf_dir):
    train, _ = frames(spark, sf_dir)
    best, scores = M.ridge_search(train, FEATS, (0.1, 1.0, 10.0, 100.0), k=4)
    return scores.withColumn("best", F.col("alpha") == F.lit(best))


@register("i4_forest_search")
def i4_forest_search(spark, sf_dir):
    train, _ = frames(spark, sf_dir)
    best, scores = M.random_search(train, FEATS, "forest", FOREST_GRID)
    return scores.withColumn("best", F.col("params") == F.lit(json.dumps(best, sort_keys=True)))


@register("i6_boosted_search")
def i6_boosted_search(spark, sf_dir):
    train, _ = frames(spark, sf_dir)
    best, scores = M.random_search(train, FEATS, "boosted", BOOSTED_GRID)
    return scores.withColumn("best", F.col("params") == F.lit(json.dumps(best, sort_keys=True)))


@register("i10_feature_importance")
def i10_feature_importance(spark, sf_dir):
    """Impurity importances of the forest and gain importances of the boosted trees (each sums to 1)."""
    train, _ = frames(spark, sf_dir)
    rf = M.importances(M.fit_forest(train, FEATS, trees=80, depth=12), FEATS).withColumn("model", F.lit("random_forest"))
    gb = M.importances(M.fit_boosted(train, FEATS), FEATS).withColumn(
        "model", F.lit("boosted_trees"))
    return rf.unionByName(gb)


@register("i12_a7_a8_best_model_roundtrip")
def i12_a7_a8_best_model_roundtrip(spark, sf_dir):
    """Pick the best model by WMAE, save it under the checkpoint folder, reload, score the last 5 rows."""
    train, test = frames(spark, sf_dir)
    models = fitted_models(train)
    board = fc.leaderboard([M.predict(m, test, n) for n, m in models.items()])
    best = fc.best_model(board).first()
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    path = f"{root.rstrip('/')}/models/best_forecaster"
    M.save_model(models[best["model"]], {"model_name": best["model"], "feature_names": FEATS,
                                         "wmae_test": best["wmae"]}, path)
    return M.load_and_score(path, test, 5).withColumn("model", F.lit(best["model"]))


@register("i7_series_forecast")
def i7_series_forecast(spark, sf_dir):
    """Seasonal ARIMA-type forecast with exogenous inputs for every (store, dept) series."""
    from storecast.operators.seasonal import forecast_series
    return forecast_series(panel(spark, sf_dir))


@register("h6_pca_store_map")
def h6_pca_store_map(spark, sf_dir):
    """PCA(2) projection of the standardised store vectors (cluster map coordinates)."""
    from storecast.operators import stats as E
    from storecast.plans.segment_queries import COLS, store_vectors
    scored, ratio = E.pca(store_vectors(spark, sf_dir).fillna(0.0, subset=COLS), COLS, 2)
    return scored.select("store", "type", "pc1", "pc2").withColumn("explained_1", F.lit(float(ratio[0]))).withColumn(
        "explained_2", F.lit(float(ratio[1])))
