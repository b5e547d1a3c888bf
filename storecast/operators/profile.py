"""B — profiling operators. Each returns a small DataFrame computed by one or two aggregates."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storecast.operators import order


def _lit_str(s: str):
    return F.lit(s).cast("string")


def head(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """B1 — first ``n`` rows in ``keys`` order (an order makes it deterministic)."""
    return df.orderBy(*keys).limit(n)


def shape(tables: Mapping[str, DataFrame]) -> DataFrame:
    """B2 — (table, rows, cols) for each named DataFrame."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"))
             .select(_lit_str(name).alias("table"), "rows", F.lit(len(df.columns)).alias("cols"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unpivot(row_df: DataFrame, names: Sequence[str], value_name: str, key_name: str = "column") -> DataFrame:
    """Turn one wide aggregate row into (column, value) rows with ``stack``."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return row_df.selectExpr(f"stack({len(names)}, {pairs}) AS ({key_name}, {value_name})")


def table_info(df: DataFrame) -> DataFrame:
    """B3 — (position, column, dtype, non_null) from one ``count(c)`` aggregate."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = _unpivot(counts, df.columns, "non_null")
    dtypes = df.sparkSession.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, column string, dtype string")
    return long.join(F.broadcast(dtypes), "column")


def columns(df: DataFrame) -> DataFrame:
    """B7 — column inventory (position, column, dtype) from the schema; no data is read."""
    return df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)],
                                           "position int, column string, dtype string")


def duplicate_count(df: DataFrame) -> DataFrame:
    """B4 — rows that repeat an earlier identical row: sum(count - 1) over full-row groups."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def null_counts(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """B5 — (column, nulls) from one aggregate; NaN counts as missing, as in pandas."""
    def missing(c, t):
        m = F.col(f"`{c}`").isNull()
        if t in ("double", "float"):
            m = m | F.isnan(F.col(f"`{c}`"))
        return F.sum(F.when(m, 1).otherwise(0)).cast("bigint").alias(c)
    row = df.agg(*[missing(c, t) for c, t in df.dtypes])
    long = _unpivot(row, df.columns, "nulls")
    return long.where(F.col("nulls") > 0) if only_positive else long


def null_total(df: DataFrame) -> DataFrame:
    """B13 — total remaining nulls across all columns."""
    return null_counts(df, only_positive=False).agg(F.sum("nulls").cast("bigint").alias("null_total"))


def missingness_by(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """B6 — share of null cells per ``by`` value and column (data behind the heat map)."""
    return df.groupBy(by).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])


def describe(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """B8 — count, mean, std (ddof 1), min, exact 25/50/75 % (linear), max per column.

    The columns are unpivoted to (column, value) so every statistic is
    one grouped aggregate and the quantiles run through the distributed
    order-statistic operator.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, value)")
    if not approx:
        long = order.materialize(long)  # read by the moments and by every quantile pass
    base = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = order.quantiles(long, "value", [0.25, 0.5, 0.75], by=["column"], names=["p25", "p50", "p75"],
                        approx=approx, written=not approx)
    return base.join(q, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def cardinality(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """B9 — distinct counts per column (``approx`` = HyperLogLog++)."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    row = df.agg(*[fn(F.col(c)).alias(c) for c in cols])
    return _unpivot(row, cols, "distinct")


def span(df: DataFrame, col: str) -> DataFrame:
    """B10 — min and max of a date column."""
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """B11 — (value, count[, share]) sorted by count desc, then value."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        tot = df.agg(F.count(F.lit(1)).alias("_t")).first()["_t"]
        g = g.withColumn("share", F.col("count") / F.lit(tot))
    return g.orderBy(F.col("count").desc(), F.col(col).asc())


def rate(df: DataFrame, col: str) -> DataFrame:
    """B12 — mean of a 0/1 or boolean column."""
    return df.agg(F.avg(F.col(col).cast("int").cast("double")).alias(f"{col}_rate"))
