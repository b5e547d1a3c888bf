"""D — aggregates behind each chart of the exploratory analysis."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storecast.functions import scalar
from storecast.operators import order


def histogram(df: DataFrame, col: str | Column, bins: int = 80, by: str | None = None,
              name: str = "x") -> DataFrame:
    """D1/D2/D4 — equal-width bins on [min, max], last bin closed.

    Edges come from one aggregate row (two literals). Without ``by`` the
    result is zero-filled from ``range(bins)``; with ``by`` each group is
    counted on the shared edges (D4) and empty cells are omitted.
    """
    x = df.select(*([by] if by else []), (F.col(col) if isinstance(col, str) else col).cast("double").alias(name))
    x = x.where(F.col(name).isNotNull())
    e = x.agg(F.min(name).alias("_lo"), F.max(name).alias("_hi")).first()  # two numbers -> literals
    lo, hi = F.lit(e["_lo"]).cast("double"), F.lit(e["_hi"]).cast("double")
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(name) - lo) / width), F.lit(bins - 1))).cast("int")
    counted = (x.withColumn("bin", b)
               .groupBy(*([by] if by else []), "bin").agg(F.count(F.lit(1)).alias("count")))
    if by:
        full = counted
    else:
        grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        full = grid.join(counted, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint"))
    return full.select(*([by] if by else []), "bin",
                       (lo + F.col("bin") * width).alias("lo"),
                       (lo + (F.col("bin") + 1) * width).alias("hi"), "count")


def holiday_share(df: DataFrame, date_col: str = "week", flag: str = "is_holiday") -> DataFrame:
    """D5 — one flag per date (max), then the share of dates per flag value; a missing level -> 0."""
    per = df.groupBy(date_col).agg(F.max(flag).alias(flag))
    levels = df.sparkSession.range(2).select(F.col("id").cast("int").alias(flag))
    cnt = per.groupBy(flag).agg(F.count(F.lit(1)).alias("dates"))
    tot = per.agg(F.count(F.lit(1)).alias("_t")).first()["_t"]
    return (levels.join(cnt, flag, "left")
            .select(flag, F.coalesce("dates", F.lit(0)).cast("bigint").alias("dates"),
                    (F.coalesce("dates", F.lit(0)) / F.lit(tot)).alias("share")))


def weekly_totals(df: DataFrame, date_col: str = "week") -> DataFrame:
    """D6 — chain total per week and whether it is a holiday week."""
    return df.groupBy(date_col).agg(F.sum("weekly_sales").alias("total_sales"),
                                    F.max("is_holiday").alias("is_holiday"))


def box_stats(df: DataFrame, by: str, col: str, k: float = 1.5) -> DataFrame:
    """D7/G8 — per group: q1, median, q3, whiskers (most extreme datum within k*IQR), flier count.

    Quartiles come from the distributed order statistics; the per-group
    fence table is joined back to the rows (one row per group).
    """
    pts = order.materialize(df.select(by, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull()))
    q = order.quantiles(pts, "_v", [0.25, 0.5, 0.75], by=[by], names=["q1", "median", "q3"], written=True)
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(by, "q1", "median", "q3", (F.col("q1") - k * iqr).alias("_lo"),
                      (F.col("q3") + k * iqr).alias("_hi"))
    x = order.join_null_safe(pts, fences, [by])
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    return x.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("fliers"),
        F.count(F.lit(1)).alias("n"))


def lift(df: DataFrame, flag: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    """D8 — mean when flag=1, mean when flag=0 and the relative lift m1/m0 - 1."""
    on = F.col(flag).cast("int") == 1
    m1 = F.avg(F.when(on, F.col(col)))
    m0 = F.avg(F.when(~on, F.col(col)))
    return df.groupBy(*by).agg(m1.alias("mean_1"), m0.alias("mean_0"), (F.try_divide(m1, m0) - 1).alias("lift"))


def pareto(df: DataFrame, key: str, col: str, n: int = 15) -> DataFrame:
    """D9 — top ``n`` keys by total with their share of the grand total and the cumulative share.

    The ranked table is the top-n (bounded by ``n``); the grand total is a one-row aggregate.
    """
    g = df.groupBy(key).agg(F.sum(col).alias("total"))
    top = g.orderBy(F.col("total").desc(), F.col(key).asc()).limit(n)
    grand = F.lit(df.agg(F.sum(col).alias("_g")).first()["_g"])
    from pyspark.sql import Window
    w = Window.orderBy(F.col("total").desc(), F.col(key).asc())  # over <= n rows
    return (top.withColumn("rank", F.row_number().over(w))
            .withColumn("share", F.col("total") / grand)
            .withColumn("cum_share", F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0)) / grand))


def store_summary(df: DataFrame) -> DataFrame:
    """D10 — mean weekly sales per store with its (constant) type and size."""
    return df.groupBy("store", "type", "size").agg(F.avg("weekly_sales").alias("mean_sales"))


def coverage(df: DataFrame, date_col: str = "week", col: str = "total_markdown") -> DataFrame:
    """D11 — share of rows per date with ``col`` > 0."""
    return df.groupBy(date_col).agg(F.avg(scalar.flag(F.col(col) > 0).cast("double")).alias("coverage"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D13 — Pearson correlation for every pair, long form (a, b, r) both orders + diagonal.

    Columns without nulls share their sums: one aggregate of sums and products about the columns'
    means, instead of six buffers for each pair. Only pairs with nulls have sums of their own
    (pairwise-complete rows). A column that doesn't vary over a pair's rows has no correlation (null).
    """
    d = order.materialize(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    first = d.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.min(c) < F.max(c)).alias("varies")).alias(c) for c in cols]).first()
    used = [c for c in cols if first[c]["varies"]]
    whole = [c for c in used if first[c]["n"] == first["n"]]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    x = {c: F.col(c) - F.lit(first[c]["mean"]) for c in used}
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(x[c]).alias(f"s {c}") for c in whole], *[F.sum(x[c] * x[c]).alias(f"q {c}") for c in whole]]
    result = {}
    for a, b in pairs:
        if a not in used or b not in used:
            result[a, b] = F.lit(None).cast("double")
            continue
        p = f"{a} {b}"
        aggs.append(F.sum(x[a] * x[b]).alias(f"q {p}"))
        if a in whole and b in whole:
            n, sums, squares = F.col("n"), [F.col(f"s {c}") for c in (a, b)], [F.col(f"q {c}") for c in (a, b)]
        else:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            aggs += [F.count_if(both).alias(f"n {p}")]
            for k, c in ((1, a), (2, b)):
                own = F.when(both, x[c])
                aggs += [F.sum(own).alias(f"s{k} {p}"), F.sum(own * own).alias(f"q{k} {p}")]
            n, sums, squares = F.col(f"n {p}"), [F.col(f"s{k} {p}") for k in (1, 2)], [F.col(f"q{k} {p}") for k in (1, 2)]
        # what rounding leaves of a constant column's sum of squares is no variation
        about = [F.try_divide(s * s, n) for s in sums]
        spread = [F.when(q - m > 1e-13 * q, q - m) for q, m in zip(squares, about)]
        result[a, b] = (F.col(f"q {p}") - F.try_divide(sums[0] * sums[1], n)) / F.sqrt(spread[0] * spread[1])
    row = d.agg(*aggs).select(*[result[a, b].alias(f"{a}__{b}") for a, b in pairs])
    parts = ", ".join(f"'{a}', '{b}', `{a}__{b}`, '{b}', '{a}', `{a}__{b}`" for a, b in pairs)
    long = row.selectExpr(f"stack({2 * len(pairs)}, {parts}) AS (a, b, r)")
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, r double")
    return long.unionByName(diag)


def kde(df: DataFrame, col: str, by: str, grid_size: int = 200, cut: float = 3.0,
        max_grid_rows: int = 1_000_000) -> DataFrame:
    """D14 — Gaussian KDE per group on a regular grid, Scott bandwidth n^(-1/5) * std (ddof 1).

    Grid = [min - cut*bw, max + cut*bw] in ``grid_size`` points per
    group. The grid (groups x grid_size rows) is size-checked before it
    is broadcast; the data side stays partitioned and every task sums
    its rows' kernels, then one grouped sum adds the partials.
    """
    x = df.select(by, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    st = x.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_s"),
                           F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    st = st.withColumn("_bw", F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_s"))
    groups = st.count()
    if groups * grid_size > max_grid_rows:
        raise ValueError(f"kde grid of {groups} x {grid_size} rows exceeds {max_grid_rows}")
    lo = F.col("_mn") - cut * F.col("_bw")
    step = (F.col("_mx") - F.col("_mn") + 2 * cut * F.col("_bw")) / F.lit(float(grid_size - 1))
    grid = (st.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))))
            .select(F.col(by).alias("_g"), "gi", (lo + F.col("gi") * step).alias("x"), "_bw", "_n"))
    z = (F.col("_v") - F.col("x")) / F.col("_bw")
    dens = (x.join(F.broadcast(grid), x[by] == grid["_g"])
            .groupBy("_g", "gi", "x", "_bw", "_n").agg(F.sum(F.exp(-0.5 * z * z)).alias("_k")))
    norm = F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi))
    return dens.select(F.col("_g").alias(by), "gi", "x", (F.col("_k") / norm).alias("density"))


def overlap_matrix(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """D17/G9 — co-occurrence counts sum(a*b) for every ordered pair of 0/1 flags (X^T X)."""
    row = df.agg(*[F.sum(F.col(a).cast("long") * F.col(b).cast("long")).alias(f"{a}__{b}")
                   for a in flags for b in flags])
    parts = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a in flags for b in flags)
    return row.selectExpr(f"stack({len(flags) ** 2}, {parts}) AS (a, b, both)")


def basket_matrix(df: DataFrame, basket: Sequence[str], item: str, flag: str,
                  items: Sequence[str]) -> DataFrame:
    """D18 — wide 0/1 matrix (basket rows x item columns) with max aggregation, missing -> 0.

    Offered for small item lists only (``items`` is explicit); the
    basket miner works on the long form instead.
    """
    if len(items) > 1000:
        raise ValueError("pivot is limited to 1,000 items; use the long form")
    return df.groupBy(*basket).pivot(item, list(items)).agg(F.max(flag)).fillna(0)
