"""J — market baskets: activity thresholds, baskets, bounded-length frequent itemsets, rules.

Itemset counting is level-wise. Baskets are grouped once (a shuffle by
basket id; a basket holds at most the distinct frequent items). Each
level extends the frequent itemsets of the previous level by one larger
item: every task builds a 0/1 matrix for a chunk of its baskets and
multiplies the product columns of the candidate itemsets with it
(``P^T X``), so a task emits one partial count per (candidate, item)
instead of one row per co-occurring pair in a basket. Spark then sums
the partials with a map-side combined aggregate. Nothing is capped:
candidates and items are processed in blocks that bound task memory.
"""

from __future__ import annotations

import math
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.operators import order

_CELL_BUDGET = 1 << 22  # dense cells per block (float32 / int64 accumulators)


def activity_threshold(df: DataFrame, item: str = "dept", col: str = "weekly_sales",
                       frac: float = 0.5) -> DataFrame:
    """J1 — per item: ``frac`` x its median value over all weeks."""
    med = order.quantiles(df, col, [0.5], by=[item], names=["median"])
    return med.select(item, (F.col("median") * F.lit(frac)).alias("threshold"))


def baskets_from_panel(df: DataFrame, basket: Sequence[str] = ("store", "week"), item: str = "dept",
                       col: str = "weekly_sales", frac: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """J2/J3 — (long active (basket..., item) rows, one-row basket count N over *all* baskets).

    Active = value >= threshold (a negative median gives a negative
    threshold). The threshold table has one row per item.
    """
    thr = activity_threshold(df, item, col, frac)
    act = (df.join(thr, item).where(F.col(col) >= F.col("threshold"))
           .select(*basket, F.col(item).cast("string").alias("item")).distinct())
    n = df.select(*basket).distinct().agg(F.count(F.lit(1)).alias("n_baskets"))
    return act, n


def _extend_counts(cands: np.ndarray, n_items: int):
    """Task function: for each basket chunk, count candidate itemset x larger item co-occurrences."""
    width = cands.shape[1]
    row_block = max(1, _CELL_BUDGET // max(n_items, 1))
    last = cands.max(axis=1) if len(cands) else np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not len(cands):
            return
        chunk = max(64, min(4096, _CELL_BUDGET // max(n_items, 1)))
        # one batch of baskets in memory at a time; its counts go out and are summed by Spark
        parts = ([np.asarray(x, dtype=np.int64) for x in pdf["items"][b0:b0 + chunk] if len(x)]
                 for pdf in batches for b0 in range(0, len(pdf), chunk))
        for part in (p for p in parts if p):
            for r0 in range(0, len(cands), row_block):
                cb = cands[r0:r0 + row_block]
                acc = np.zeros((len(cb), n_items), dtype=np.int64)
                x = np.zeros((len(part), n_items), dtype=np.float32)
                rows = np.repeat(np.arange(len(part)), [len(p) for p in part])
                x[rows, np.concatenate(part)] = 1.0
                p = x[:, cb[:, 0]]
                for j in range(1, width):
                    p = p * x[:, cb[:, j]]
                acc += (p.T @ x).astype(np.int64)
            # keep only extensions by a larger item (each itemset counted once)
            mask = np.arange(n_items)[None, :] > last[r0:r0 + row_block][:, None]
            ri, ki = np.nonzero((acc > 0) & mask)
            if len(ri):
                yield pd.DataFrame({"cand": (ri + r0).astype(np.int64), "k": ki.astype(np.int32),
                                    "cnt": acc[ri, ki]})
    return run


def frequent_itemsets(baskets: DataFrame, basket_cols: Sequence[str], n_baskets: DataFrame,
                      min_support: float = 0.05, max_len: int = 3) -> DataFrame:
    """J4 — itemsets with support >= ``min_support`` and size <= ``max_len``.

    ``baskets``: long (basket_cols..., item) rows. ``n_baskets``: one row
    with ``n_baskets`` (the support denominator, which may include empty
    baskets). Returns (items array<string> sorted, size, count, support).
    """
    spark = baskets.sparkSession
    n = n_baskets.first()["n_baskets"]
    min_count = max(1, math.ceil(min_support * n))  # count / n >= min_support
    long = baskets.select(*basket_cols, F.col("item").cast("string").alias("item")).distinct()
    singles = long.groupBy("item").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    # dense index over the frequent items (support-bounded: <= occurrences / min_count rows)
    vocab = singles.withColumn("idx", (F.row_number().over(Window.orderBy("item")) - 1).cast("int"))
    vocab = vocab.checkpoint() if spark.sparkContext.getCheckpointDir() else vocab.cache()
    n_items = vocab.count()
    levels = [vocab.select(F.array("item").alias("items"), F.array("idx").alias("idxs"), "count")]
    if n_items and max_len >= 2:
        grouped = (long.join(F.broadcast(vocab.select("item", "idx")), "item")
                   .groupBy(*basket_cols).agg(F.collect_list("idx").alias("items")).select("items"))
        grouped = grouped.checkpoint() if spark.sparkContext.getCheckpointDir() else grouped.cache()
        current = levels[0]
        schema = T.StructType([T.StructField("cand", T.LongType()), T.StructField("k", T.IntegerType()),
                               T.StructField("cnt", T.LongType())])
        for size in range(2, max_len + 1):
            cand_df = current.select("idxs").withColumn(
                "cand", (F.row_number().over(Window.orderBy("idxs")) - 1).cast("long"))
            cand_df = cand_df.checkpoint() if spark.sparkContext.getCheckpointDir() else cand_df.cache()
            # support-bounded list of the previous level's frequent itemsets (ints only)
            rows = cand_df.orderBy("cand").collect()
            if not rows:
                break
            cands = np.array([r["idxs"] for r in rows], dtype=np.int64)
            counts = (grouped.mapInPandas(_extend_counts(cands, n_items), schema)
                      .groupBy("cand", "k").agg(F.sum("cnt").alias("count"))
                      .where(F.col("count") >= min_count))
            nxt = (counts.join(cand_df, "cand")
                   .select(F.concat("idxs", F.array(F.col("k"))).alias("idxs"), "count"))
            names = vocab.select("idx", "item")
            nxt = (nxt.select(F.posexplode("idxs").alias("pos", "idx"), "idxs", "count")
                   .join(F.broadcast(names), "idx")
                   .groupBy("idxs", "count").agg(F.sort_array(F.collect_list("item")).alias("items"))
                   .select("items", "idxs", "count"))
            nxt = nxt.checkpoint() if spark.sparkContext.getCheckpointDir() else nxt.cache()
            if nxt.limit(1).count() == 0:
                break
            levels.append(nxt)
            current = nxt
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out.select(F.array_sort("items").alias("items"), F.size("items").alias("size"),
                      F.col("count").cast("bigint").alias("count"),
                      (F.col("count") / F.lit(float(n))).alias("support"))


def itemset_key(c) -> "F.Column":
    return F.array_join(F.array_sort(c), ", ")


def association_rules(itemsets: DataFrame, n_baskets: int | None = None, min_lift: float = 1.1) -> DataFrame:
    """J5 — every non-empty proper subset of every itemset as antecedent; support, confidence, lift.

    Subsets are enumerated with a bit mask per itemset (2^size - 2 rows,
    size <= max_len). Confidence and lift come from whole counts:
    n_xy / n_x and n_xy * N / (n_x * n_y).
    """
    sup = itemsets.select(F.array_sort("items").alias("key"), F.col("count").alias("_c"))
    big = itemsets.where(F.col("size") >= 2).withColumn("_n", F.col("count") / F.col("support"))
    masks = big.withColumn("mask", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.col("size")).cast("int") - 2)))
    def bit(i):
        return (F.col("mask") / F.pow(F.lit(2), i)).cast("long") % 2
    ant = F.filter("items", lambda x, i: bit(i) == 1)
    con = F.filter("items", lambda x, i: bit(i) == 0)
    rules = masks.select(ant.alias("antecedents"), con.alias("consequents"), F.col("count").alias("n_xy"),
                         "support", "_n")
    a = sup.select(F.col("key").alias("ak"), F.col("_c").alias("n_x"))
    c = sup.select(F.col("key").alias("ck"), F.col("_c").alias("n_y"))
    # joined on the item arrays: an item may itself hold the separator of the text form
    rules = (rules.withColumn("ak", F.array_sort("antecedents")).withColumn("ck", F.array_sort("consequents"))
             .join(a, "ak").join(c, "ck"))
    rules = rules.select(
        "antecedents", "consequents",
        itemset_key("ak").alias("antecedents_str"), itemset_key("ck").alias("consequents_str"),
        "support", (F.col("n_xy") / F.col("n_x")).alias("confidence"),
        (F.col("n_xy") * F.col("_n") / (F.col("n_x") * F.col("n_y"))).alias("lift"))
    return rules.where(F.col("lift") >= min_lift)


def top_rules(rules: DataFrame, n: int = 15) -> DataFrame:
    """J6 — top ``n`` by lift (ties: support, then the item strings), five output columns."""
    return (rules.orderBy(F.col("lift").desc(), F.col("support").desc(), "antecedents_str", "consequents_str")
            .limit(n).select("antecedents_str", "consequents_str", "support", "confidence", "lift"))


def rules_bubble(rules: DataFrame, n: int = 80) -> DataFrame:
    """J7 — first ``n`` rules in a fixed order as (confidence, lift, support) bubble data."""
    return (rules.orderBy("antecedents_str", "consequents_str").limit(n)
            .select("antecedents_str", "consequents_str", "confidence", "lift", "support"))
