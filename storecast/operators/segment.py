"""H — store segmentation: entity vectors, KMeans search, cluster quality, DBSCAN, bisecting hierarchy.

Facts are reduced to one vector per entity by a single grouped
aggregate. Pairwise measures (silhouette, DBSCAN neighbours) run on
entity blocks: each entity is routed to the block pairs it belongs to,
and one task per block pair computes the distances with NumPy and emits
per-(entity, cluster) partial sums or true neighbours only, never one
row per pair of entities.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.functions.scalar import safe_max1

SEG_COLS = ["mean_weekly", "std_weekly", "hol_lift", "mean_md", "mean_cpi", "mean_unemp", "size"]


def entity_vectors(df: DataFrame, key: str = "store") -> DataFrame:
    """H1 — per store: mean, std (ddof 1), holiday lift mean(hol)/max(mean(non-hol), 1),
    mean markdown, CPI, unemployment, size, type."""
    hol = F.col("is_holiday") == 1
    return df.groupBy(key).agg(
        F.avg("weekly_sales").alias("mean_weekly"),
        F.stddev_samp("weekly_sales").alias("std_weekly"),
        (F.avg(F.when(hol, F.col("weekly_sales"))) / safe_max1(F.avg(F.when(~hol, F.col("weekly_sales"))))).alias("hol_lift"),
        F.avg("total_markdown").alias("mean_md"),
        F.avg("cpi").alias("mean_cpi"),
        F.avg("unemployment").alias("mean_unemp"),
        F.first("size", ignorenulls=True).cast("double").alias("size"),
        F.first("type", ignorenulls=True).alias("type"))


# ---------------------------------------------------------------- blocked pairs

def _blocks(df: DataFrame, id_col: str, block_rows: int) -> tuple[DataFrame, int]:
    n = df.count()
    nb = max(1, math.ceil(n / block_rows))
    return df.withColumn("_blk", F.pmod(F.xxhash64(F.col(id_col)), F.lit(nb)).cast("int")), nb


def _route(df: DataFrame, nb: int) -> DataFrame:
    """Copy each row to every (left block, right block) pair it takes part in, tagged by side."""
    others = F.sequence(F.lit(0), F.lit(nb - 1))
    left = df.select("*", F.col("_blk").alias("_a"), F.explode(others).alias("_b"), F.lit(0).alias("_side"))
    right = df.select("*", F.explode(others).alias("_a"), F.col("_blk").alias("_b"), F.lit(1).alias("_side"))
    return left.unionByName(right)


def silhouette(df: DataFrame, cols: Sequence[str], label: str, id_col: str = "store",
               block_rows: int = 2048) -> DataFrame:
    """H4 — mean silhouette with plain Euclidean distance (exact); singleton clusters score 0.

    Per block pair, a task sums each left entity's distances to the
    right entities by right cluster; a grouped sum over block pairs then
    gives (entity, cluster, distance sum, count).
    """
    cols = list(cols)
    base = df.select(F.col(id_col).alias("_id"), F.col(label).alias("_lab"), *[F.col(c).cast("double") for c in cols])
    base, nb = _blocks(base, "_id", block_rows)
    routed = _route(base, nb)
    out_schema = T.StructType([T.StructField("_id", base.schema["_id"].dataType),
                               T.StructField("_lab", base.schema["_lab"].dataType),
                               T.StructField("_to", base.schema["_lab"].dataType),
                               T.StructField("_dsum", T.DoubleType()), T.StructField("_cnt", T.LongType())])

    def pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        L = pdf[pdf["_side"] == 0]
        R = pdf[pdf["_side"] == 1]
        xl = L[cols].to_numpy(dtype=float)
        xr = R[cols].to_numpy(dtype=float)
        d = np.sqrt(np.maximum(((xl[:, None, :] - xr[None, :, :]) ** 2).sum(-1), 0.0))
        rows = []
        rlab = R["_lab"].to_numpy()
        for lab in pd.unique(rlab):
            m = rlab == lab
            rows.append(pd.DataFrame({"_id": L["_id"].to_numpy(), "_lab": L["_lab"].to_numpy(), "_to": lab,
                                      "_dsum": d[:, m].sum(axis=1), "_cnt": np.int64(m.sum())}))
        return pd.concat(rows) if rows else pd.DataFrame(columns=[f.name for f in out_schema.fields])

    sums = (routed.groupBy("_a", "_b").applyInPandas(pair_sums, out_schema)
            .groupBy("_id", "_lab", "_to").agg(F.sum("_dsum").alias("_dsum"), F.sum("_cnt").alias("_cnt")))
    own = F.col("_to") == F.col("_lab")
    per = sums.groupBy("_id", "_lab").agg(
        F.max(F.when(own, F.col("_cnt"))).alias("_n_own"),
        F.max(F.when(own, F.col("_dsum"))).alias("_d_own"),
        F.min(F.when(~own, F.col("_dsum") / F.col("_cnt"))).alias("_b"))
    a = F.try_divide(F.col("_d_own"), F.col("_n_own") - 1)
    # coincident points: 0 / 0 scores 0, as in the singleton case
    s = F.when((F.col("_n_own") <= 1) | F.col("_b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - a, F.greatest(a, F.col("_b"))), F.lit(0.0)))
    return per.agg(F.avg(s).alias("silhouette"))


def davies_bouldin(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """H5 — mean over clusters of max_j (S_i + S_j) / d(c_i, c_j), S = mean distance to centroid.

    Centroids are one grouped aggregate (k rows, k = the model's
    cluster count); the k x k step runs on that small table.
    """
    cols = list(cols)
    cent = df.groupBy(label).agg(*[F.avg(c).alias(f"_c_{c}") for c in cols])
    dist = F.sqrt(sum((F.col(c) - F.col(f"_c_{c}")) ** 2 for c in cols))
    scat = df.join(cent, label).groupBy(label).agg(F.avg(dist).alias("_s"))
    small = cent.join(scat, label).withColumn("_g", F.lit(0))

    def db(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf[[f"_c_{x}" for x in cols]].to_numpy(dtype=float)
        s = pdf["_s"].to_numpy(dtype=float)
        d = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(-1))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (s[:, None] + s[None, :]) / d
        np.fill_diagonal(r, -np.inf)
        return pd.DataFrame({"davies_bouldin": [float(np.max(r, axis=1).mean()) if len(s) > 1 else float("nan")]})

    return small.groupBy("_g").applyInPandas(db, "davies_bouldin double")


# ---------------------------------------------------------------- KMeans

#: Rows of one task of a KMeans fit, at least (no more tasks than the input has partitions).
KMEANS_ROWS = 20_000


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector of ``cols``; a null or NaN counts as the column's mean, so every row stays
    (0 when a column has no value at all)."""
    from pyspark.ml.feature import VectorAssembler
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    means = df.agg(*[F.avg(value[c]).alias(c) for c in cols]).first()
    filled = df.withColumns({f"__f_{c}": F.coalesce(value[c], F.lit(float(means[c] or 0.0))) for c in cols})
    vec = VectorAssembler(inputCols=[f"__f_{c}" for c in cols], outputCol=out, handleInvalid="error").transform(filled)
    return vec.drop(*[f"__f_{c}" for c in cols])


def kmeans(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42, n_init: int = 4,
           label: str = "cluster", max_iter: int = 50):
    """H3 — KMeans with ``n_init`` restarts (different seeds), keeping the lowest training cost.

    Every restart is some 15 jobs over all partitions, so these follow the number of rows: a cached
    aggregate keeps all its shuffle partitions, nearly all of them empty when entities are few.
    Returns (labelled DataFrame, cost).
    """
    from pyspark.ml.clustering import KMeans
    tasks = max(1, math.ceil(df.count() / KMEANS_ROWS))
    x = assemble(df, cols).coalesce(tasks).cache()
    best, best_cost = None, float("inf")
    for i in range(n_init):
        m = KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol=label, maxIter=max_iter).fit(x)
        cost = m.summary.trainingCost
        if cost < best_cost:
            best, best_cost = m, cost
    return best.transform(x).drop("features"), best_cost


def k_search(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 9), seed: int = 42,
             n_init: int = 4, id_col: str = "store") -> DataFrame:
    """H2 — inertia and silhouette for each k; ``best`` marks the argmax silhouette (first on ties)."""
    spark = df.sparkSession
    df = df.cache()  # entity vectors (one row per store) are re-read by every fit
    rows = []
    for k in ks:
        lab, cost = kmeans(df, cols, k, seed, n_init)
        sil = silhouette(lab, cols, "cluster", id_col).first()["silhouette"]
        rows.append((int(k), float(cost), float(sil)))
    df.unpersist()
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    return spark.createDataFrame([(k, c, s, k == best) for k, c, s in rows],
                                 "k int, inertia double, silhouette double, best boolean")


def cluster_profile(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """H11 — (cluster mean - overall mean) / overall std (ddof 1), long form (label, feature, z)."""
    cols = list(cols)
    ov = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]).first()
    per = df.groupBy(label).agg(*[((F.avg(c) - F.lit(ov[f"_m_{c}"])) / F.lit(ov[f"_s_{c}"])).alias(c) for c in cols])
    parts = ", ".join(f"'{c}', `{c}`" for c in cols)
    return per.selectExpr(f"`{label}`", f"stack({len(cols)}, {parts}) AS (feature, z)")


def cluster_summary(df: DataFrame, label: str) -> DataFrame:
    """H12 — per cluster: store count, store-type mix (map type -> count), mean sales, mean lift."""
    mix = df.groupBy(label, "type").agg(F.count(F.lit(1)).alias("_c"))
    mix = mix.groupBy(label).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "_c")))).alias("type_mix"))
    base = df.groupBy(label).agg(F.count(F.lit(1)).alias("stores"), F.avg("mean_weekly").alias("mean_weekly"),
                                 F.avg("hol_lift").alias("hol_lift"))
    return base.join(mix, label)


def bisecting(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42, label: str = "bisect") -> DataFrame:
    """H7 — top-down hierarchy by bisecting KMeans, cut at ``k`` clusters (no single merge task at any size)."""
    from pyspark.ml.clustering import BisectingKMeans
    x = assemble(df, cols)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol=label).fit(x)
    return model.transform(x).drop("features")


def split_table(df: DataFrame, cols: Sequence[str], max_k: int, seed: int = 42) -> DataFrame:
    """H8 — the hierarchy as a table: for each cut of 1..``max_k`` clusters the cluster sizes (largest first)
    and the within-cluster sum of squares (the height of the next split is its drop)."""
    spark = df.sparkSession
    rows = []
    for k in range(1, max_k + 1):
        lab = bisecting(df, cols, k, seed, "c") if k > 1 else df.withColumn("c", F.lit(0))
        within = sum(F.var_pop(c) * F.count(F.lit(1)) for c in cols)
        per = lab.groupBy("c").agg(F.count(F.lit(1)).alias("n"), within.alias("w"))  # at most k rows
        rows.append((k, *per.agg(F.sort_array(F.collect_list("n"), False), F.sum("w")).first()))
    return spark.createDataFrame(rows, "k int, sizes array<long>, within double")


# ---------------------------------------------------------------- DBSCAN

def dbscan(df: DataFrame, cols: Sequence[str], eps: float = 1.5, min_samples: int = 3,
           id_col: str = "store", block_rows: int = 2048) -> DataFrame:
    """H10 — DBSCAN: (id, label) with -1 for noise.

    Neighbour pairs within ``eps`` come from the blocked distance tasks
    (only true neighbours are emitted). Core points have at least
    ``min_samples`` neighbours counting themselves. Cluster labels are
    connected components of the core graph, found by min-label propagation
    with pointer jumping until no label changes: the rounds grow with the
    logarithm of a cluster's diameter. Each round is checkpointed.
    Border points join the smallest neighbouring core label; labels are
    renumbered 0.. by the smallest member id.
    """
    cols = list(cols)
    base = df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double") for c in cols])
    base, nb = _blocks(base, "_id", block_rows)
    routed = _route(base, nb)
    id_type = base.schema["_id"].dataType
    schema = T.StructType([T.StructField("src", id_type), T.StructField("dst", id_type)])

    def neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
        L = pdf[pdf["_side"] == 0]
        R = pdf[pdf["_side"] == 1]
        d2 = ((L[cols].to_numpy(float)[:, None, :] - R[cols].to_numpy(float)[None, :, :]) ** 2).sum(-1)
        i, j = np.nonzero(d2 <= eps * eps)
        return pd.DataFrame({"src": L["_id"].to_numpy()[i], "dst": R["_id"].to_numpy()[j]})

    spark = df.sparkSession
    ckpt = spark.sparkContext.getCheckpointDir() is not None
    edges = routed.groupBy("_a", "_b").applyInPandas(neighbours, schema)
    edges = edges.checkpoint() if ckpt else edges.cache()
    deg = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    core = deg.where(F.col("deg") >= min_samples).select(F.col("src").alias("_id"))
    core_edges = (edges.join(core.withColumnRenamed("_id", "src"), "src")
                  .join(core.withColumnRenamed("_id", "dst"), "dst").select("src", "dst"))
    labels = core.select("_id", F.col("_id").alias("lab"))
    while True:
        prop = (core_edges.join(labels.withColumnRenamed("_id", "dst"), "dst")
                .groupBy("src").agg(F.min("lab").alias("nl")))
        new = (labels.join(prop.withColumnRenamed("src", "_id"), "_id", "left")
               .select("_id", F.least("lab", F.coalesce("nl", F.col("lab"))).alias("lab")))
        # a label is itself a core point: follow it to its own label
        jump = new.select(F.col("_id").alias("lab"), F.col("lab").alias("_next"))
        new = new.join(jump, "lab").select("_id", F.least("lab", "_next").alias("lab"))
        new = new.checkpoint() if ckpt else new.cache()
        changed = new.join(labels.withColumnRenamed("lab", "old"), "_id").where(F.col("lab") != F.col("old")).limit(1).count()
        labels = new
        if not changed:
            break
    border = (edges.join(labels.withColumnRenamed("_id", "dst"), "dst")
              .join(core.withColumnRenamed("_id", "src"), "src", "left_anti")
              .groupBy("src").agg(F.min("lab").alias("lab")).withColumnRenamed("src", "_id"))
    all_lab = labels.unionByName(border)
    # renumber components 0.. in order of their smallest core point, as a scan in id order
    # would discover them (one row per cluster)
    from pyspark.sql import Window
    first = labels.select("lab").distinct().withColumn(
        "cluster", (F.row_number().over(Window.orderBy("lab")) - 1).cast("int"))
    out = base.select("_id").join(all_lab, "_id", "left").join(first.select("lab", "cluster"), "lab", "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("dbscan"))
