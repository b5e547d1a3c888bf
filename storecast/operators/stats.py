"""E — hypothesis tests and reductions from distributed sufficient statistics.

Each test is one (or two) distributed aggregates that reduce the
facts to a handful of numbers per group; only the final formula and the
tail probability run on the one-row result.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storecast.functions import distributions as dist
from storecast.operators import order


def _two_samples(df: DataFrame, col: str, flag: str) -> DataFrame:
    g = F.col(flag).cast("int")
    return df.select(F.col(col).cast("double").alias("_v"), F.when(g == 1, 1).when(g.isNotNull(), 0).alias("_g")).where(
        F.col("_v").isNotNull() & F.col("_g").isNotNull())


def welch_t(df: DataFrame, col: str, flag: str, alternative: str = "greater",
            p_value: bool = True) -> DataFrame:
    """E1 — Welch t of sample 1 (flag=1) against sample 0, with Welch–Satterthwaite df.

    ``alternative='greater'`` gives the reference's one-tailed p
    (two-sided p / 2 when t > 0, else 1 - p / 2); also 'less', 'two-sided'.
    """
    x = _two_samples(df, col, flag)
    s = x.agg(*[a for g in (1, 0) for a in (
        F.count(F.when(F.col("_g") == g, F.col("_v"))).alias(f"n{g}"),
        F.avg(F.when(F.col("_g") == g, F.col("_v"))).alias(f"mean{g}"),
        F.var_samp(F.when(F.col("_g") == g, F.col("_v"))).alias(f"var{g}"))])
    a1 = F.col("var1") / F.col("n1")
    a0 = F.col("var0") / F.col("n0")
    t = (F.col("mean1") - F.col("mean0")) / F.sqrt(a1 + a0)
    dof = (a1 + a0) * (a1 + a0) / (a1 * a1 / (F.col("n1") - 1) + a0 * a0 / (F.col("n0") - 1))
    out = s.select("n1", "n0", "mean1", "mean0", t.alias("t"), dof.alias("df"))
    if not p_value:
        return out
    upper = dist.t_sf(F.col("t"), F.col("df"))
    p = {"greater": upper, "less": F.lit(1.0) - upper,
         "two-sided": F.lit(2.0) * F.least(upper, F.lit(1.0) - upper)}[alternative]
    return out.withColumn("p_value", p)


def anova(df: DataFrame, col: str, by: str, p_value: bool = True) -> DataFrame:
    """E2 — one-way ANOVA F from per-group (n, mean, M2); between/within sums of squares."""
    x = df.select(by, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    g = x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("m"),
                          (F.var_pop("_v") * F.count(F.lit(1))).alias("m2"))
    tot = x.agg(F.avg("_v").alias("_gm"), F.count(F.lit(1)).alias("_N")).first()  # two scalars
    gm = F.lit(tot["_gm"])
    s = g.agg(F.sum(F.col("n") * (F.col("m") - gm) * (F.col("m") - gm)).alias("ssb"),
              F.sum("m2").alias("ssw"), F.count(F.lit(1)).alias("k")).withColumn("N", F.lit(tot["_N"]).cast("bigint"))
    d1 = F.col("k") - 1
    d2 = F.col("N") - F.col("k")
    out = s.select("ssb", "ssw", d1.alias("df_between"), d2.alias("df_within"),
                   ((F.col("ssb") / d1) / (F.col("ssw") / d2)).alias("f"))
    if p_value:
        out = out.withColumn("p_value", dist.f_sf(F.col("f"), F.col("df_between"), F.col("df_within")))
    return out


def _ranked(df: DataFrame, col: str, by: str):
    """Rank-sum per group and the tie term sum(t^3 - t), from the distributed average ranks."""
    x = order.materialize(df.select(by, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull()))
    ranks = order.average_ranks(x, "_v", written=True)
    per = x.groupBy(by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    sums = (per.join(ranks, "_v").groupBy(by)
            .agg(F.sum(F.col("_c")).alias("n"), F.sum(F.col("_c") * F.col("rank")).alias("rank_sum")))
    ties = ranks.agg(F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("tie_term"),
                     F.sum("ties").alias("N")).first()  # two scalars
    return sums, ties


def kruskal(df: DataFrame, col: str, by: str, p_value: bool = True) -> DataFrame:
    """E3 — Kruskal–Wallis H with tie correction (chi-square, k-1 df)."""
    sums, ties = _ranked(df, col, by)
    s = (sums.agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_r"),
                  F.count(F.lit(1)).alias("k"))
         .withColumn("tie_term", F.lit(float(ties["tie_term"] or 0.0))).withColumn("N", F.lit(ties["N"]).cast("bigint")))
    n = F.col("N").cast("double")
    h = (F.lit(12.0) / (n * (n + 1)) * F.col("_r") - 3 * (n + 1)) / (
        F.lit(1.0) - F.col("tie_term") / (n * n * n - n))
    out = s.select(h.alias("h"), (F.col("k") - 1).alias("df"), F.col("N").alias("n"))
    if p_value:
        out = out.withColumn("p_value", dist.chi2_sf(F.col("h"), F.col("df")))
    return out


def mann_whitney(df: DataFrame, col: str, flag: str, alternative: str = "greater",
                 p_value: bool = True) -> DataFrame:
    """E4 — Mann–Whitney U of sample 1 (flag=1) with the normal approximation,
    continuity correction 0.5 and tie correction."""
    x = _two_samples(df, col, flag)
    sums, ties = _ranked(x, "_v", "_g")
    s = sums.agg(F.sum(F.when(F.col("_g") == 1, F.col("rank_sum"))).alias("r1"),
                 F.sum(F.when(F.col("_g") == 1, F.col("n"))).alias("n1"),
                 F.sum(F.when(F.col("_g") == 0, F.col("n"))).alias("n0")).withColumn(
        "tie_term", F.lit(float(ties["tie_term"] or 0.0)))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("r1") - n1 * (n1 + 1) / 2
    mu = n1 * n0 / 2
    sigma = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    sign = {"greater": 1.0, "less": -1.0, "two-sided": 0.0}[alternative]
    if sign == 0.0:
        z = (F.abs(u - mu) - 0.5) / sigma
    else:
        z = (F.lit(sign) * (u - mu) - 0.5) / sigma
    out = s.select(F.col("n1"), F.col("n0"), u.alias("u"), z.alias("z"))
    if p_value:
        p = dist.norm_sf(F.col("z"))
        out = out.withColumn("p_value", F.least(p * 2, F.lit(1.0)) if sign == 0.0 else p)
    return out


def pca(df: DataFrame, cols: Sequence[str], k: int = 2, standardize: bool = True):
    """E8/H6 — principal components of the (standardised) columns.

    Returns (scores DataFrame with pc1..pck, explained-variance ratio
    list). Spark ML PCA fits from a distributed covariance matrix
    (cols x cols); signs are fixed so the largest loading is positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    from storecast.operators.features import standardize as std
    from storecast.operators.segment import assemble

    xv = assemble(std(df, cols) if standardize else df, cols, "_x")
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(xv)
    loadings = model.pc.toArray()
    signs = []
    for j in range(k):
        col_j = loadings[:, j]
        signs.append(1.0 if col_j[abs(col_j).argmax()] >= 0 else -1.0)
    arr = vector_to_array("_pc")
    scored = model.transform(xv).select(
        *[c for c in df.columns], *[(arr[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(k)])
    return scored, list(model.explainedVariance.toArray())
