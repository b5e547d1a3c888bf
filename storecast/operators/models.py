"""I1-I6, I10, I13, A7, A8 — forecasting models.

Linear models are distributed aggregates; tree ensembles are grown in parallel
tasks over all training rows (``trees``). All (draw, fold) pairs of a model
search are fitted at once, on expanding time folds (I11).
"""

from __future__ import annotations

import json
import random
import uuid
from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storecast.operators import features as fe
from storecast.operators import forecast as fc
from storecast.operators import trees as tr
from storecast.session import ensure_checkpoint_dir

LABEL = "weekly_sales"


def model_frame(panel: DataFrame) -> DataFrame:
    """Engineered rows with every lag present, dept code added, model features null-free."""
    df = fe.dept_codes(fe.model_rows(fe.engineer(panel, iqr=False)))
    num = [c for c in fe.FORECAST_FEATURES]
    return df.fillna(0, subset=num)


def _assembler(feats: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(feats), outputCol="features", handleInvalid="keep")


def fit_linear(train: DataFrame, feats: Sequence[str]) -> PipelineModel:
    """I1 — ordinary least squares (normal equations; standardising does not change OLS predictions)."""
    lr = LinearRegression(featuresCol="features", labelCol=LABEL, solver="normal", regParam=0.0)
    return Pipeline(stages=[_assembler(feats), lr]).fit(train)


class RidgeModel:
    """Closed-form ridge on population-standardised features (scikit-learn ``Ridge`` after
    ``StandardScaler``): beta = (Z'Z + alpha I)^-1 Z'(y - mean y). Scores with one Column expression."""

    def __init__(self, feats, mean, std, y_mean, beta, alpha):
        self.feats, self.mean, self.std, self.y_mean, self.beta, self.alpha = feats, mean, std, y_mean, beta, alpha

    def prediction(self):
        expr = F.lit(float(self.y_mean))
        for f, m, s, b in zip(self.feats, self.mean, self.std, self.beta):
            expr = expr + F.lit(float(b)) * (F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s))
        return expr

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction())

    def pipeline(self) -> PipelineModel:
        """The same model as a pipeline that can be saved."""
        terms = [f"{float(b)!r}D * (CAST(`{f}` AS DOUBLE) - {float(m)!r}D) / {float(s)!r}D"
                 for f, m, s, b in zip(self.feats, self.mean, self.std, self.beta)]
        return PipelineModel([SQLTransformer(statement=f"SELECT *, {' + '.join([f'{float(self.y_mean)!r}D', *terms])} AS prediction FROM __THIS__")])


def gram_blocks(df: DataFrame, feats: Sequence[str], block: str | None = None) -> list[dict]:
    """Shifted first and second moments of (features, label) per block, in two aggregates.

    Pass 1 finds a shift (the overall means); pass 2 sums n, sum(d), sum(d d') over
    shifted values d per block. The result is (p+1)^2 numbers per block, whatever the row count.
    """
    import numpy as np
    cols = list(feats) + [LABEL]
    c0 = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    shift = [float(c0[c] or 0.0) for c in cols]
    d = [F.col(c).cast("double") - F.lit(s) for c, s in zip(cols, shift)]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(x).alias(f"s{i}") for i, x in enumerate(d)]
    aggs += [F.sum(d[i] * d[j]).alias(f"q{i}_{j}") for i in range(len(d)) for j in range(i, len(d))]
    grouped = df.groupBy(block).agg(*aggs) if block else df.agg(*aggs)
    out = []
    p = len(cols)
    for r in grouped.collect():
        q = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                q[i, j] = q[j, i] = r[f"q{i}_{j}"] or 0.0
        out.append({"block": r[block] if block else None, "n": r["n"],
                    "s": np.array([r[f"s{i}"] or 0.0 for i in range(p)]), "q": q, "shift": np.array(shift)})
    return out


def ridge_from_moments(parts: list[dict], feats: Sequence[str], alpha: float) -> RidgeModel:
    """Solve ridge from summed shifted moments (exact up to float rounding)."""
    import numpy as np
    n = sum(p["n"] for p in parts)
    s = sum(p["s"] for p in parts)
    q = sum(p["q"] for p in parts)
    shift = parts[0]["shift"]
    mean_d = s / n
    cov = q / n - np.outer(mean_d, mean_d)  # population covariance of (x, y)
    k = len(feats)
    # a column that is constant in these blocks has the rounding of its sums as variance: it counts as 0
    flat = np.flatnonzero(np.diag(cov)[:k] <= 1e-11 * mean_d[:k] ** 2)
    cov[flat, :] = cov[:, flat] = 0.0
    var = np.clip(np.diag(cov)[:k], 0, None)
    std = np.sqrt(var)
    std[std == 0] = 1.0
    zz = cov[:k, :k] * n / np.outer(std, std)
    zy = cov[:k, k] * n / std
    beta = np.linalg.solve(zz + alpha * np.eye(k), zy)
    return RidgeModel(list(feats), (mean_d + shift)[:k], std, (mean_d + shift)[k], beta, alpha)


def fit_ridge(train: DataFrame, feats: Sequence[str], alpha: float) -> RidgeModel:
    """I2 — ridge with scikit-learn's penalty ``alpha * ||b||^2`` on population-standardised features,
    from one distributed moment aggregate ((p+1)^2 sums)."""
    return ridge_from_moments(gram_blocks(train, feats), feats, alpha)


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{name}-{uuid.uuid4().hex[:12]}"


def fit_forest(train: DataFrame, feats: Sequence[str], trees: int = 200, depth: int = 18, min_instances: int = 1, max_features: str = "all",
               seed: int = 42, max_bins: int = 64) -> tr.TreeEnsemble:
    """I3 — random forest using all features per split (the reference library's default)."""
    params = {"trees": trees, "depth": depth, "min_instances": min_instances, "max_features": max_features}
    return tr.fit(train, feats, LABEL, "forest", _folder(train.sparkSession, "forest"), params, seed, max_bins)


def fit_boosted(train: DataFrame, feats: Sequence[str], rounds: int = 600, depth: int = 8, lr: float = 0.05, subsample: float = 0.9,
                colsample: float = 0.9, seed: int = 42, max_bins: int = 64) -> tr.TreeEnsemble:
    """I5 — gradient-boosted trees (rows and features sampled per round)."""
    params = {"rounds": rounds, "depth": depth, "lr": lr, "subsample": subsample, "colsample": colsample}
    return tr.fit(train, feats, LABEL, "boosted", _folder(train.sparkSession, "boosted"), params, seed, max_bins)


def predict(model: PipelineModel | tr.TreeEnsemble, df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """I13 — score rows and return the long prediction form for metrics."""
    return fc.predictions(model.transform(df), name, "prediction", keep=keep)


def random_search(train: DataFrame, feats: Sequence[str], kind: str, grid: dict, n_iter: int = 6, k: int = 3, seed: int = 42) -> tuple[dict, DataFrame]:
    """I4/I6 — seeded draws from ``grid``, scored by RMSE on ``k`` expanding time folds of all rows.

    All (draw, fold) pairs are fitted at once, in tasks of their own. Returns (best params, per-draw
    scores DataFrame). The caller refits the best draw on the whole training set.
    """
    spark = train.sparkSession
    rng = random.Random(seed)
    combos = [{}]
    for key, values in grid.items():
        combos = [dict(c, **{key: v}) for c in combos for v in values]
    draws = rng.sample(combos, min(n_iter, len(combos)))
    folds = fc.time_folds(train, k)
    # one row per date in the fold table
    tagged = train.join(F.broadcast(folds.select("week", "fold_test")), "week")
    found = tr.search_scores(tagged, feats, LABEL, kind, draws, k, seed).collect()  # one row per draw
    scores = [(r["draw"], json.dumps(draws[r["draw"]], sort_keys=True), r["cv_rmse"]) for r in found]
    best = min(scores, key=lambda s: (s[2], s[0]))
    table = spark.createDataFrame(scores, "draw int, params string, cv_rmse double")
    return json.loads(best[1]), table


def ridge_search(train: DataFrame, feats: Sequence[str], alphas=(0.1, 1.0, 10.0, 100.0), k: int = 4):
    """I2 — alpha by mean RMSE over ``k`` expanding time folds; returns (alpha, scores DataFrame).

    One moment aggregate per date block gives every fold's training
    moments by summation, so the whole grid needs two passes over the
    rows for fitting plus one grouped scoring pass per alpha.
    """
    spark = train.sparkSession
    folds = fc.time_folds(train, k)
    tagged = train.join(F.broadcast(folds.select("week", "fold_test")), "week").cache()
    parts = gram_blocks(tagged, feats, "fold_test")
    scores = []
    for a in alphas:
        preds = None
        for f in range(1, k + 1):
            model = ridge_from_moments([p for p in parts if p["block"] < f], feats, a)
            te = tagged.where(F.col("fold_test") == f)
            p = fc.predictions(model.transform(te), "ridge", "prediction").withColumn("fold", F.lit(f))
            preds = p if preds is None else preds.unionByName(p)
        per_fold = fc.metrics(preds, ["fold"]).agg(F.avg("rmse").alias("cv_rmse")).first()["cv_rmse"]
        scores.append((float(a), float(per_fold)))
    tagged.unpersist()
    best = min(scores, key=lambda s: (s[1], s[0]))[0]
    return best, spark.createDataFrame(scores, "alpha double, cv_rmse double")


def importances(model: tr.TreeEnsemble, feats: Sequence[str]) -> DataFrame:
    """I10 — tree feature importances (sum to 1) as a sorted DataFrame."""
    df = model.spark.createDataFrame([(f, float(v)) for f, v in zip(feats, model.importances)], "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature")


def save_model(model: PipelineModel | tr.TreeEnsemble, meta: dict, path: str) -> None:
    """A7 — persist the fitted model and a one-row metadata table (name, features, test WMAE)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    is_trees = isinstance(model, tr.TreeEnsemble)
    if is_trees:
        model.save(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    meta = {**meta, "kind": "trees" if is_trees else "pipeline"}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").write.mode("overwrite").json(f"{path}/meta")


def load_and_score(path: str, df: DataFrame, n: int = 5) -> DataFrame:
    """A8 — reload the model and score the last ``n`` rows by date (store, dept tie keys)."""
    spark = df.sparkSession
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    model = tr.TreeEnsemble.load(spark, f"{path}/model") if meta["kind"] == "trees" else PipelineModel.load(f"{path}/model")
    last = df.orderBy(F.col("week").desc(), F.col("store").desc(), F.col("dept").desc()).limit(n)
    return model.transform(last).select(F.col("week").alias("date"), "store", "dept",
                                        F.col(LABEL).alias("actual"), F.round("prediction", 2).alias("predicted"))
