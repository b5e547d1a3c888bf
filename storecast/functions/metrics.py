"""I8 — forecast error metrics as aggregate expressions (one pass, any grouping)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: holiday weeks weigh 5, other weeks 1 (weighted MAE).
HOLIDAY_WEIGHT = 5.0


def metric_aggs(y: str = "y", yhat: str = "yhat", holiday: str = "is_holiday") -> list[Column]:
    """WMAE, RMSE, MAE, R2 and row count for use in ``agg``.

    R2 = 1 - SSE / SST with SST = n * var_pop(y) (Welford-stable, one pass); null when y is constant.
    """
    err = F.col(y) - F.col(yhat)
    w = F.when(F.col(holiday).cast("boolean"), F.lit(HOLIDAY_WEIGHT)).otherwise(F.lit(1.0))
    sse = F.sum(err * err)
    return [
        F.count(F.lit(1)).alias("n"),
        (F.sum(w * F.abs(err)) / F.sum(w)).alias("wmae"),
        F.sqrt(sse / F.count(F.lit(1))).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.lit(1.0) - F.try_divide(sse, F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
    ]


def mape_agg(y: str = "y", yhat: str = "yhat") -> Column:
    """K2 — mean absolute percentage error over rows with |y| > 0."""
    return F.avg(F.when(F.abs(F.col(y)) > 0, F.abs((F.col(y) - F.col(yhat)) / F.col(y)))).alias("mape")
