"""Distributed exact order statistics: quantiles and average ranks.

Spark's exact ``percentile`` aggregate keeps a value->count map per
group and merges it in one task, and a window with no partition key
runs in one task; both break when one group holds a large share of the
rows. Here values are cut into value buckets whose edges come from one
approximate-quantile pass (edges are plain literals afterwards, so
every re-execution buckets identically). Per-(group, bucket) counts
give each bucket's offset; only the buckets that hold a wanted position
are opened, and inside them only the distinct values are ranked. A hot
value is one row of its bucket's distinct-value table, so no task ever
holds a hot group's rows.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS = 64
MAX_BUCKETS = 65_536
#: Rows of one task of a table kept in memory: at most, and at least while cores are free.
ROWS_PER_TASK, LEAST_PER_TASK = 50_000, 2_000


def materialize(df: DataFrame) -> DataFrame:
    """Write a narrow intermediate once and read it back (checkpoint in ``spark.checkpoint.dir``;
    cache only when no folder is configured). Used where one projection is read several times."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint(eager=True)
    return df.cache()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and kept in memory, on as many tasks as its rows need. A plan that is only cached keeps
    all its shuffle partitions, which many passes over few rows pay for each time."""
    df = materialize(df)
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, math.ceil(n / ROWS_PER_TASK), min(math.ceil(n / LEAST_PER_TASK), cores))
    return df.repartition(tasks).cache()


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; the result has the left side's keys."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(other, cond, how).drop(*[f"__r_{k}" for k in keys])


def bucket_edges(d: DataFrame, col: str) -> list[float]:
    """Edges splitting ``col`` into buckets of about ``ROWS_PER_BUCKET`` rows.

    One pass returns the row count and a ``MIN_BUCKETS``-way sketch; a
    second, finer sketch pass only runs when the data has more than
    ``MIN_BUCKETS x ROWS_PER_BUCKET`` rows.
    """
    def sketch(b: int):
        return F.percentile_approx(col, [i / b for i in range(1, b)], 10 * b)
    first = d.agg(F.count(F.lit(1)).alias("n"), sketch(MIN_BUCKETS).alias("q")).first()
    n, qs = first["n"], first["q"]
    if not n:
        return []
    b = int(min(MAX_BUCKETS, max(MIN_BUCKETS, math.ceil(n / ROWS_PER_BUCKET))))
    if b > MIN_BUCKETS:
        qs = d.agg(sketch(b).alias("q")).first()["q"]
    return sorted({float(x) for x in (qs or []) if x is not None and not math.isnan(x)})


def _bucketed(d: DataFrame, col: str) -> DataFrame:
    edges = bucket_edges(d, col)
    splits = [-math.inf] + edges + [math.inf]
    if len(splits) < 3:
        return d.withColumn("_bk", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=col, outputCol="_bk", handleInvalid="keep").transform(d)


def _bucket_counts(b: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., _bk, _c, _off, _n): rows per bucket, rows in earlier buckets, rows in the group."""
    by = list(by)
    cnt = b.groupBy(*by, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    return (cnt.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
            .withColumn("_n", F.sum("_c").over(Window.partitionBy(*by))))


def _value_spans(b: DataFrame, cnt: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """(by..., _bk, value, ties, first, last): 1-based position span of each distinct value."""
    by = list(by)
    vals = b.groupBy(*by, "_bk", col).agg(F.count(F.lit(1)).alias("ties"))
    w = Window.partitionBy(*by, "_bk").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("_cum", F.sum("ties").over(w))
    vals = join_null_safe(vals, cnt.select(*by, "_bk", "_off"), [*by, "_bk"])
    return vals.select(*by, "_bk", col, "ties", (F.col("_off") + F.col("_cum") - F.col("ties") + 1).alias("first"),
                       (F.col("_off") + F.col("_cum")).alias("last"))


def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
              names: Sequence[str] | None = None, approx: bool = False,
              accuracy: int = 10000, written: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / ``quantile_cont``), per ``by`` group.

    Nulls and NaNs are skipped. ``written``: ``df`` is already a materialised narrow table. ``approx=True`` uses ``percentile_approx``
    (one pass, bounded sketch) where an estimate is enough.
    """
    by = list(by)
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    v = F.col(col).cast("double")
    d = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not approx and not written:
        # the (group, value) projection is read by the edge jobs, the counts and the opened
        # buckets: write it once instead of re-deriving the upstream plan for every read
        d = materialize(d)
    if approx:
        out = d.groupBy(*by).agg(F.percentile_approx("_v", list(probs), accuracy).alias("_q"))
        return out.select(*by, *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
    b = _bucketed(d, "_v")
    cnt = _bucket_counts(b, by)
    if not by:
        return _global_quantiles(b, cnt, probs, names)
    sizes = cnt.select(*by, "_n").distinct()
    # wanted 1-based positions: lo = floor(h) + 1, hi = ceil(h) + 1 with h = (n - 1) p
    tg = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        tg.append(F.struct(F.lit(i).alias("k"), (F.floor(h) + 1).alias("lo"), (F.ceil(h) + 1).alias("hi"),
                           (h - F.floor(h)).alias("frac")))
    targets = sizes.select(*by, F.explode(F.array(*tg)).alias("t")).select(*by, "t.*")
    tpos = targets.select(*by, "k", F.explode(F.array(F.struct(F.lit("lo").alias("which"), F.col("lo").alias("pos")),
                                                        F.struct(F.lit("hi").alias("which"), F.col("hi").alias("pos")))).alias("x")
                          ).select(*by, "k", "x.which", "x.pos")
    hit = join_null_safe(tpos, cnt, by).where((F.col("pos") > F.col("_off")) & (F.col("pos") <= F.col("_off") + F.col("_c")))
    hit = hit.select(*by, "k", "which", "pos", "_bk")
    open_bk = hit.select(*by, "_bk").distinct()
    spans = _value_spans(join_null_safe(b, open_bk, [*by, "_bk"], "left_semi"), cnt, "_v", by)
    picked = (join_null_safe(hit, spans, [*by, "_bk"]).where((F.col("pos") >= F.col("first")) & (F.col("pos") <= F.col("last")))
              .groupBy(*by, "k").agg(F.max(F.when(F.col("which") == "lo", F.col("_v"))).alias("_lo"),
                                     F.max(F.when(F.col("which") == "hi", F.col("_v"))).alias("_hi")))
    res = join_null_safe(picked, targets.select(*by, "k", "frac"), [*by, "k"])
    val = F.when(F.col("frac") == 0, F.col("_lo")).otherwise(F.col("_lo") + F.col("frac") * (F.col("_hi") - F.col("_lo")))
    res = res.select(*by, "k", val.alias("_q"))
    return res.groupBy(*by).agg(*[F.max(F.when(F.col("k") == i, F.col("_q"))).alias(nm) for i, nm in enumerate(names)])


def _global_quantiles(b: DataFrame, cnt: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """No groups: the wanted positions are plain numbers, so the buckets to open and the values
    at those positions are picked with literal conditions (one small aggregate, no join)."""
    n = cnt.agg(F.sum("_c").alias("n")).first()["n"] or 0
    if n == 0:
        return b.sparkSession.createDataFrame([tuple(None for _ in names)],
                                              ", ".join(f"`{nm}` double" for nm in names))
    wanted = []
    for p in probs:
        h = (n - 1) * float(p)
        wanted.append((math.floor(h) + 1, math.ceil(h) + 1, h - math.floor(h)))
    positions = sorted({x for lo, hi, _ in wanted for x in (lo, hi)})
    hit = None
    for pos in positions:
        c = (F.lit(pos) > F.col("_off")) & (F.lit(pos) <= F.col("_off") + F.col("_c"))
        hit = c if hit is None else hit | c
    open_bk = cnt.where(hit).select("_bk")
    spans = _value_spans(b.join(open_bk, ["_bk"], "left_semi"), cnt, "_v", [])

    def at(pos):
        return F.max(F.when((F.col("first") <= pos) & (F.col("last") >= pos), F.col("_v")))
    vals = spans.agg(*[at(pos).alias(f"p{pos}") for pos in positions])
    outs = []
    for (lo, hi, frac), nm in zip(wanted, names):
        v_lo, v_hi = F.col(f"p{lo}"), F.col(f"p{hi}")
        outs.append((v_lo if frac == 0 else v_lo + F.lit(frac) * (v_hi - v_lo)).alias(nm))
    return vals.select(*outs)


def average_ranks(df: DataFrame, col: str, by: Sequence[str] = (), written: bool = False) -> DataFrame:
    """W6 — one row per distinct value: (by..., value, ties, rank); tied values share the mean
    of their 1-based positions in ascending order."""
    by = list(by)
    d = df.select(*by, F.col(col).cast("double").alias(col)).where(F.col(col).isNotNull())
    d = d if written else materialize(d)
    b = _bucketed(d, col)
    cnt = _bucket_counts(b, by)
    spans = _value_spans(b, cnt, col, by)
    return spans.select(*by, col, "ties", ((F.col("first") + F.col("last")) / F.lit(2.0)).alias("rank"))
