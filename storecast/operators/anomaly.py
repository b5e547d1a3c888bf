"""G — anomaly detectors: isolation forest, local outlier factor, seasonal-residual z-scores.

* Isolation forest: a seeded pool of rows is drawn by hash (its size
  depends only on trees x sub-sample), every tree takes its own
  sub-sample from the pool, trees are grown in one grouped-map task per
  tree (<= 256 rows each), and the small forest table is broadcast to
  score every row in Arrow batches.
* LOF: exact k nearest neighbours on entity blocks (one task per block
  pair keeps only the k best per row), then k-distance, reachability
  and local densities as joins and aggregates.
* STL: one grouped-map task per (store, dept) series on its regular
  weekly grid; a series holds at most one row per week.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.operators import order, windows
from storecast.operators.order import materialize
from storecast.operators.features import standardize

AD_COLS = ["weekly_sales", "total_markdown", "temperature", "cpi", "unemployment", "size",
           "is_holiday", "month", "week_of_year"]
KEYS = ["store", "dept", "week"]


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search, c(n) (isolation-forest normaliser)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


# ------------------------------------------------------------------ isolation forest

def _grow_tree(cols: Sequence[str], psi: int, seed: int):
    height_limit = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + tree)
        x = pdf[list(cols)].to_numpy(dtype=float)
        nodes = []  # (node, feature, threshold, left, right, size, is_leaf)

        def build(idx, depth):
            nid = len(nodes)
            nodes.append(None)
            xs = x[idx]
            if depth >= height_limit or len(idx) <= 1:
                nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx), True)
                return nid
            lo, hi = xs.min(axis=0), xs.max(axis=0)
            cand = np.nonzero(hi > lo)[0]
            if len(cand) == 0:
                nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx), True)
                return nid
            f = int(rng.choice(cand))
            t = float(rng.uniform(lo[f], hi[f]))
            go_left = xs[:, f] < t
            left = build(idx[go_left], depth + 1)
            right = build(idx[~go_left], depth + 1)
            nodes[nid] = (nid, f, t, left, right, len(idx), False)
            return nid

        build(np.arange(len(x)), 0)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "leaf"])
        out.insert(0, "tree", tree)
        return out
    return grow


def fit_isolation_forest(df: DataFrame, cols: Sequence[str] = AD_COLS, keys: Sequence[str] = KEYS,
                         trees: int = 200, psi: int = 256, seed: int = 42, pool_factor: int = 4) -> DataFrame:
    """G1 — grow the forest; returns the node table (tree, node, feature, threshold, left, right, size, leaf).

    The pool holds about ``pool_factor * trees * psi`` rows chosen by a
    seeded hash threshold; each tree keeps the ``psi`` pool rows with the
    smallest (row, tree) hash, so a tree's sample is uniform and without
    replacement. Sizes are bounded by the parameters, not by the data.
    """
    n = df.count()
    psi = int(min(psi, n))
    pool_rate = min(1.0, pool_factor * trees * psi / max(n, 1))
    h = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    u = (F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30))
    pool = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).where(u < pool_rate)
    pool_size = max(1.0, pool_rate * n)
    per_tree = pool.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    rank_h = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed), F.col("_tree"))
    rank_u = F.pmod(rank_h, F.lit(1 << 30)).cast("double") / float(1 << 30)
    # keep about 4 x psi candidates per tree before the per-tree sort (narrow filter, no shuffle
    # of the exploded pool); each tree then takes its psi smallest hashes
    keep = min(1.0, 4.0 * psi / pool_size)
    per_tree = per_tree.withColumn("_u", rank_u).where(F.col("_u") < keep)
    w = Window.partitionBy("_tree").orderBy("_u", *keys)
    sample = per_tree.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r", "_u")
    schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
                           T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
                           T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
                           T.StructField("size", T.IntegerType()), T.StructField("leaf", T.BooleanType())])
    forest = sample.fillna(0.0, subset=list(cols)).groupBy("_tree").applyInPandas(_grow_tree(cols, psi, seed), schema)
    return forest.withColumn("psi", F.lit(psi))


def score_isolation_forest(df: DataFrame, forest: DataFrame, cols: Sequence[str] = AD_COLS,
                           out: str = "if_score") -> DataFrame:
    """G1 — anomaly score 2^(-E[h(x)] / c(psi)) for every row (vectorised tree walks per batch).

    The forest (<= trees x 2 x psi nodes) is collected once and shipped
    as a broadcast variable.
    """
    spark = df.sparkSession
    rows = forest.orderBy("tree", "node").collect()
    psi = rows[0]["psi"] if rows else 1
    n_trees = max(r["tree"] for r in rows) + 1 if rows else 0
    max_nodes = max(r["node"] for r in rows) + 1 if rows else 1
    arr = {k: np.zeros((n_trees, max_nodes), dtype=dt) for k, dt in
           (("feature", np.int64), ("threshold", np.float64), ("left", np.int64), ("right", np.int64),
            ("size", np.int64), ("leaf", bool))}
    for r in rows:
        for k in arr:
            arr[k][r["tree"], r["node"]] = r[k]
    # expected remaining path length below each leaf, computed once per node (not per row)
    arr["cpath"] = np.vectorize(c_factor, otypes=[float])(arr["size"].astype(float))
    bc = spark.sparkContext.broadcast(arr)
    cn = c_factor(psi)
    cols = list(cols)

    def score(batches):
        a = bc.value
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            x = np.nan_to_num(x, nan=0.0)
            total = np.zeros(len(x))
            for t in range(a["feature"].shape[0]):
                node = np.zeros(len(x), dtype=np.int64)
                depth = np.zeros(len(x))
                active = ~a["leaf"][t, node]
                while active.any():
                    f = a["feature"][t, node[active]]
                    go_left = x[active, f] < a["threshold"][t, node[active]]
                    node[active] = np.where(go_left, a["left"][t, node[active]], a["right"][t, node[active]])
                    depth[active] += 1
                    active = ~a["leaf"][t, node]
                total += depth + a["cpath"][t, node]
            mean_h = total / max(a["feature"].shape[0], 1)
            pdf[out] = np.power(2.0, -mean_h / cn) if cn > 0 else 0.5
            yield pdf

    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
    return df.mapInPandas(score, schema)


def flag_top(df: DataFrame, score: str, contamination: float, out: str) -> DataFrame:
    """Flag rows whose score is above the (1 - contamination) exact quantile (one-row threshold).

    The scores are materialised first: the threshold and the flags both
    read them, and re-deriving model scores per read would repeat the model.
    """
    df = materialize(df)
    thr = order.quantiles(df, score, [1.0 - contamination], names=["_thr"]).first()["_thr"]
    return df.withColumn(out, F.when(F.col(score) > F.lit(thr), 1).otherwise(0))


def contamination_sweep(scored: DataFrame, score: str, rates: Sequence[float],
                        flag_col: str = "is_holiday") -> DataFrame:
    """G2/G4 — one scoring pass, several thresholds: (rate, flagged share, holiday share inside flags)."""
    scored = materialize(scored)
    thr = order.quantiles(scored, score, [1.0 - r for r in rates], names=[f"t{i}" for i in range(len(rates))]).first()
    x = scored
    aggs = []
    for i, r in enumerate(rates):
        flagged = F.col(score) > F.lit(thr[f"t{i}"])
        aggs += [F.avg(flagged.cast("double")).alias(f"s{i}"),
                 F.avg(F.when(flagged, F.col(flag_col).cast("double"))).alias(f"h{i}")]
    row = x.agg(*aggs)
    parts = ", ".join(f"{float(r)}D, s{i}, h{i}" for i, r in enumerate(rates))
    return row.selectExpr(f"stack({len(rates)}, {parts}) AS (rate, flagged_share, holiday_share)")


# ------------------------------------------------------------------ LOF

def knn(df: DataFrame, cols: Sequence[str], k: int, id_col: str = "_id", block_rows: int = 16384) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, self excluded): (id, nbr, dist, rank).

    Rows are hashed into blocks; every block pair is one task that keeps
    the ``k`` nearest right rows for each left row, so at most
    k x blocks candidates per row reach the final top-k window.
    """
    from storecast.operators.segment import _blocks, _route
    cols = list(cols)
    base = df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double") for c in cols]).fillna(0.0, subset=cols)
    base, nb = _blocks(base, "_id", block_rows)
    routed = _route(base, nb)
    schema = T.StructType([T.StructField("_id", base.schema["_id"].dataType),
                           T.StructField("nbr", base.schema["_id"].dataType),
                           T.StructField("dist", T.DoubleType())])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        L = pdf[pdf["_side"] == 0]
        R = pdf[pdf["_side"] == 1]
        xl, xr = L[cols].to_numpy(float), R[cols].to_numpy(float)
        lid, rid = L["_id"].to_numpy(), R["_id"].to_numpy()
        outs = []
        step = 256
        for s in range(0, len(xl), step):
            a = xl[s:s + step]
            d2 = (a * a).sum(1)[:, None] + (xr * xr).sum(1)[None, :] - 2.0 * (a @ xr.T)
            d = np.sqrt(np.maximum(d2, 0.0))
            d[lid[s:s + step, None] == rid[None, :]] = np.inf
            kk = min(k, d.shape[1])
            if kk == 0:
                continue
            idx = np.argpartition(d, kk - 1, axis=1)[:, :kk]
            dd = np.take_along_axis(d, idx, axis=1)
            ok = np.isfinite(dd)
            rows = np.repeat(np.arange(len(dd)), kk).reshape(dd.shape)
            outs.append(pd.DataFrame({"_id": lid[s:s + step][rows[ok]], "nbr": rid[idx[ok]], "dist": dd[ok]}))
        return pd.concat(outs) if outs else pd.DataFrame({"_id": [], "nbr": [], "dist": []})

    cand = routed.groupBy("_a", "_b").applyInPandas(best, schema)
    w = Window.partitionBy("_id").orderBy("dist", "nbr")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lof_scores(neigh: DataFrame, k: int) -> DataFrame:
    """LOF from a kNN table (any max-k >= k): (id, lof)."""
    nk = neigh.where(F.col("rank") <= k)
    kdist = nk.groupBy("_id").agg(F.max("dist").alias("kdist"))
    reach = (nk.join(kdist.select(F.col("_id").alias("nbr"), F.col("kdist").alias("nk")), "nbr")
             .withColumn("rd", F.greatest("dist", "nk")))
    lrd = reach.groupBy("_id").agg((F.lit(1.0) / (F.avg("rd") + F.lit(1e-10))).alias("lrd"))
    ratio = (nk.join(lrd.select(F.col("_id").alias("nbr"), F.col("lrd").alias("nlrd")), "nbr")
             .groupBy("_id").agg(F.avg("nlrd").alias("_m")))
    return ratio.join(lrd, "_id").select("_id", (F.col("_m") / F.col("lrd")).alias("lof"))


def lof(df: DataFrame, cols: Sequence[str] = AD_COLS, keys: Sequence[str] = KEYS, k: int = 35,
        contamination: float = 0.01) -> DataFrame:
    """G3 — standardised features, exact kNN, LOF; flags the top ``contamination`` share. Returns
    keys + lof + lof_anomaly."""
    x = standardize(df.select(*keys, *cols), list(cols)).withColumn("_id", F.xxhash64(*[F.col(c) for c in keys]))
    neigh = knn(x, cols, k)
    sc = lof_scores(neigh, k)
    out = x.select("_id", *keys).join(sc, "_id")
    return flag_top(out, "lof", contamination, "lof_anomaly").drop("_id")


# ------------------------------------------------------------------ STL and classical decomposition

def _loess(y: np.ndarray, q: int, degree: int = 1, weights: np.ndarray | None = None,
           x_out: np.ndarray | None = None) -> np.ndarray:
    """LOESS on a regular grid with tricube weights over the q nearest points (Cleveland et al. 1990).

    On an evenly spaced series the q nearest points form a window, so
    all local fits are done at once as (points x q) array operations.
    """
    n = len(y)
    xo = np.arange(n, dtype=float) if x_out is None else np.asarray(x_out, dtype=float)
    rw = np.ones(n) if weights is None else weights
    qq = max(2, min(q, n))
    s = np.clip(np.floor(xo - (qq - 1) / 2.0 + 0.5).astype(int), 0, n - qq)
    idx = s[:, None] + np.arange(qq)[None, :]
    d = np.abs(idx - xo[:, None])
    h = d.max(axis=1)
    if q > n:
        h = h + (q - n) // 2  # halved as an integer, as in the published routine
    h = np.maximum(h, 1e-12)
    u = d / h[:, None]
    tri = np.where(u < 1, (1 - u ** 3) ** 3, 0.0)
    w = tri * rw[idx]
    sw = w.sum(axis=1)
    empty = sw <= 0
    if empty.any():  # every neighbour down-weighted to 0: fall back to distance weights only
        w[empty] = tri[empty]
        sw = w.sum(axis=1)
    yy = y[idx]
    with np.errstate(invalid="ignore", divide="ignore"):
        ym = (w * yy).sum(axis=1) / sw
        if degree == 0:
            return ym
        xm = (w * idx).sum(axis=1) / sw
        dx = idx - xm[:, None]
        sxx = (w * dx * dx).sum(axis=1)
        b = np.where(sxx > 1e-12, (w * dx * (yy - ym[:, None])).sum(axis=1) / np.where(sxx > 1e-12, sxx, 1.0), 0.0)
        return ym + b * (xo - xm)


def _odd(v: float) -> int:
    v = int(math.ceil(v))
    return v if v % 2 == 1 else v + 1


def stl(y: np.ndarray, period: int = 52, seasonal: int = 7, robust: bool = True) -> tuple[np.ndarray, ...]:
    """STL decomposition (seasonal-trend by LOESS) of a regular series; returns (trend, seasonal, resid)."""
    n = len(y)
    trend_w = _odd(1.5 * period / (1 - 1.5 / seasonal))
    low_w = _odd(period + 1)
    inner, outer = (2, 15) if robust else (2, 0)
    trend = np.zeros(n)
    season = np.zeros(n)
    rw = np.ones(n)
    for it in range(outer + 1):
        for _ in range(inner):
            detr = y - trend
            c = np.zeros(n + 2 * period)
            for ph in range(period):
                idx = np.arange(ph, n, period)
                if len(idx) == 0:
                    continue
                xo = np.arange(-1, len(idx) + 1, dtype=float)
                sm = _loess(detr[idx], seasonal, 1, rw[idx], xo)
                for j, pos in enumerate(range(ph - period, n + period, period)):
                    if 0 <= pos + period < n + 2 * period and j < len(sm):
                        c[pos + period] = sm[j]
            ma = np.convolve(c, np.ones(period) / period, mode="valid")
            ma = np.convolve(ma, np.ones(period) / period, mode="valid")
            ma = np.convolve(ma, np.ones(3) / 3, mode="valid")
            low = _loess(ma, low_w, 1)
            season = c[period:period + n] - low[:n]
            trend = _loess(y - season, trend_w, 1, rw)
        if it < outer:
            r = np.abs(y - season - trend)
            h = 6 * np.median(r)
            u = r / h if h > 0 else np.zeros(n)
            rw = np.where(u < 1, (1 - u ** 2) ** 2, 0.0)
    return trend, season, y - trend - season


def stl_anomalies(grid: DataFrame, by: Sequence[str] = ("store", "dept"), value: str = "weekly_sales",
                  date_col: str = "week", period: int = 52, z: float = 3.0, robust: bool = True) -> DataFrame:
    """G5 — per series on the regular weekly grid: skip (flag 0) with fewer than 2*period + 5 observed
    weeks; interpolate; STL; z-score of the residual (std ddof 1 + 1e-9); flag |z| > ``z``.

    ``status`` is 'ok', or 'short' for a skipped series (its parts are null). Weeks before the first
    observed one have null parts and flag 0."""
    by = list(by)
    g = windows.interpolate_linear(grid.withColumn("_obs", F.col(value).isNotNull().cast("int")), value,
                                   by, date_col, out="_y")
    fields = [grid.schema[c] for c in by] + [T.StructField(date_col, T.DateType()),
                                             *[T.StructField(c, T.DoubleType()) for c in ("trend", "seasonal", "resid", "stl_z")],
                                             T.StructField("stl_anomaly", T.IntegerType()), T.StructField("status", T.StringType())]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date_col)
        res = pd.DataFrame({c: pdf[c].to_numpy() for c in by})
        res[date_col] = pdf[date_col].to_numpy()
        y = pdf["_y"].to_numpy(dtype=float)
        if pdf["_obs"].sum() < 2 * period + 5:
            res["trend"] = res["seasonal"] = res["resid"] = res["stl_z"] = np.nan
            res["stl_anomaly"], res["status"] = 0, "short"
            return res
        start = int(np.argmax(~np.isnan(y)))
        for name, part in zip(("trend", "seasonal", "resid"), stl(y[start:], period, robust=robust)):
            res[name] = np.r_[np.full(start, np.nan), part]
        resid = res["resid"].to_numpy()
        res["stl_z"] = (resid - np.nanmean(resid)) / (np.nanstd(resid, ddof=1) + 1e-9)
        res["stl_anomaly"] = (np.abs(np.nan_to_num(res["stl_z"].to_numpy())) > z).astype(np.int32)
        res["status"] = "ok"
        return res

    return g.select(*by, date_col, "_y", "_obs").groupBy(*by).applyInPandas(run, T.StructType(fields))


def _fixed(c: Column | str, scale: float = 1e4) -> Column:
    """Value as an integer count of 1/``scale`` units (IEEE multiply, add, floor: the same in any engine)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(col * F.lit(scale) + F.lit(0.5)).cast("long")


def classical_decompose(grid: DataFrame, by: Sequence[str] = ("store", "dept"), value: str = "_y",
                        date_col: str = "week", period: int = 52) -> DataFrame:
    """G7 fast path — additive classical decomposition with pure window expressions.

    trend = centred 2 x ``period`` moving average (NULL at the ends);
    seasonal = mean detrended value per phase (row index mod period),
    centred over the phases; resid = y - trend - seasonal. Sums run on
    fixed-point integers (1e-4 units), so they are exact and do not
    depend on the summation order of any engine.
    """
    by = list(by)
    scale = 1e4
    w = Window.partitionBy(*by).orderBy(date_col)
    half = period // 2
    frame = w.rowsBetween(-half, half)
    q = _fixed(value, scale)
    full = F.count(value).over(frame) == period + 1
    if period % 2 == 0:
        num2 = F.lit(2) * F.sum(q).over(frame) - (F.lag(q, half).over(w) + F.lead(q, half).over(w))
        ma = num2.cast("double") / F.lit(2.0 * scale * period)
    else:
        ma = F.sum(q).over(frame).cast("double") / F.lit(scale * period)
    x = grid.withColumn("_i", F.row_number().over(w) - 1).withColumn("trend", F.when(full, ma))
    x = x.withColumn("_ph", F.col("_i") % period).withColumn("_dt", F.col(value) - F.col("trend"))
    ph = x.groupBy(*by, "_ph").agg((F.sum(_fixed("_dt", scale)).cast("double") / F.lit(scale)
                                    / F.count("_dt")).alias("_s"))
    all_ph = Window.partitionBy(*by)
    centre = F.sum(_fixed("_s", scale)).over(all_ph).cast("double") / F.lit(scale) / F.count("_s").over(all_ph)
    ph = ph.withColumn("seasonal", F.col("_s") - centre)
    return (x.join(ph.select(*by, "_ph", "seasonal"), [*by, "_ph"])
            .select(*by, date_col, F.col(value).alias("y"), "trend", "seasonal",
                    (F.col(value) - F.col("trend") - F.col("seasonal")).alias("resid")))


def top_series(df: DataFrame, by: Sequence[str] = ("store", "dept"), value: str = "weekly_sales",
               n: int = 100) -> DataFrame:
    """G6 — the ``n`` series with the largest total (a top-n report; ties by key)."""
    by = list(by)
    return (df.groupBy(*by).agg(F.sum(value).alias("total"))
            .orderBy(F.col("total").desc(), *by).limit(n))


def stl_flags_on_panel(panel: DataFrame, n_series: int = 100, by: Sequence[str] = ("store", "dept"),
                       value: str = "weekly_sales", date_col: str = "week") -> DataFrame:
    """G5 + G6 write-back: STL flags for the ``n_series`` largest series, 0 for every other row.

    The top-series list is a semi join (no collect); flags are joined back on the row key and
    missing ones become 0, like the reference's column initialised to 0.
    """
    by = list(by)
    top = top_series(panel, by, value, n_series).select(*by)
    series = panel.select(*by, date_col, value).join(top, by, "left_semi")
    flags = stl_anomalies(windows.weekly_grid(series, by, date_col), by, value, date_col)
    return (panel.join(flags.select(*by, date_col, "stl_anomaly"), [*by, date_col], "left")
            .withColumn("stl_anomaly", F.coalesce(F.col("stl_anomaly"), F.lit(0))))
