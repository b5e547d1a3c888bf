"""C — projections, fills, joins, calendar parts, samples and top-k."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C1 — every null in ``cols`` becomes 0."""
    return df.fillna(0, subset=[c for c in cols if c in df.columns])


def ffill_bfill(df: DataFrame, cols: Sequence[str], by: Sequence[str], order: str) -> DataFrame:
    """C2/W3 — last non-null value so far, else the next non-null value, within ``by``.

    A group that is all null stays null. Each group is one store's
    weekly rows, so the window partition is bounded by the calendar.
    """
    past = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(past),
                                         F.first(c, ignorenulls=True).over(future)))
    return df


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when ``keys`` repeat (pandas ``validate='many_to_one'``); one aggregate, no collect of facts."""
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"right side is not unique on {list(keys)}")


def left_join_many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str],
                          validate: bool = False) -> DataFrame:
    """C4/C5 — left equi-join; with ``validate`` the right side must be unique on ``on``.

    The join strategy is left to the planner: AQE broadcasts the right
    side only when its measured size is under the broadcast threshold.
    """
    if validate:
        assert_unique(right, on)
    return left.join(right, list(on), "left")


def row_sum(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """C8 — row-wise sum, nulls counted as 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    return df.withColumn(out, total)


def calendar(df: DataFrame, date_col: str) -> DataFrame:
    """C9 — calendar year, month, ISO week and day of month (year is not the ISO year)."""
    d = F.col(date_col)
    return (df.withColumn("year", F.year(d)).withColumn("month", F.month(d))
            .withColumn("week_of_year", F.weekofyear(d)).withColumn("day", F.dayofmonth(d)))


def select_existing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """C11 — project the listed columns that exist, in list order."""
    return df.select([c for c in cols if c in df.columns])


def clip_lower(c: Column | str, lower: float = 0.0) -> Column:
    """C13 — ``clip(lower=...)``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.greatest(col, F.lit(lower))


def sample_key(keys: Sequence[str], seed: int) -> Column:
    """Seeded hash of the key text (md5, so other engines can reproduce the same sample)."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """C16 — exactly ``n`` rows (or all when fewer), chosen by a seeded hash of ``keys``.

    The choice depends only on the key values and the seed, not on the
    partitioning, so reruns and lost executors give the same sample.
    Each task keeps its ``n`` best rows (TakeOrderedAndProject), so the
    merge holds at most ``n`` x tasks rows: ``n`` is the sample size the
    caller asked for, not a property of the data. Keys should be
    integers, strings or dates (their text form is engine-independent).
    """
    return df.withColumn("_h", sample_key(keys, seed)).orderBy("_h").limit(n).drop("_h")


def top_k(df: DataFrame, by: Sequence[str] | str, n: int, ascending: bool = False,
          tie_keys: Sequence[str] = ()) -> DataFrame:
    """C17 — first ``n`` rows by ``by`` (descending by default), ties broken by ``tie_keys``."""
    by = [by] if isinstance(by, str) else list(by)
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in by]
    order += [F.col(c).asc() for c in tie_keys]
    return df.orderBy(*order).limit(n)
