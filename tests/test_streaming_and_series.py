"""Streaming mini-batch centroids, the per-series forecaster and the CSV layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storecast.operators.seasonal import _fit_forecast
from storecast.streaming import events as ST
from tests.conftest import SF001


def test_minibatch_centroids_weights_cover_events(spark):
    cents = ST.minibatch_centroids(spark, SF001, k=3, decay=0.5)
    n = spark.read.parquet(f"{SF001}/events.parquet").where(F.col("value").isNotNull()).count()
    rows = cents.collect()
    assert len(rows) == 3
    assert sum(r["weight"] for r in rows) == pytest.approx(n)


def test_window_counts_match_batch(spark):
    s = ST.window_counts(spark, SF001, "1 day")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    b = ev.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").count()
    assert s.count() == b.count()
    assert s.agg(F.sum("events")).first()[0] == ev.count()


def test_streams_read_a_folder_of_part_files_in_any_order(spark, tmp_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev.repartition(5, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    s = ST.window_counts(spark, str(tmp_path), "1 day")
    assert s.agg(F.sum("events")).first()[0] == ev.count()
    cents = ST.minibatch_centroids(spark, str(tmp_path), k=3, decay=1.0)  # several batches: the merge runs
    assert cents.agg(F.sum("weight")).first()[0] == pytest.approx(ev.where(F.col("value").isNotNull()).count())


@pytest.mark.parametrize("weeks,status", [(143, "one lag"), (228, "seasonal lag"), (260, "full")])
def test_forecaster_has_a_plan_for_short_series(weeks, status):
    rng = np.random.default_rng(3)
    y = 100 + np.arange(weeks) + 10 * np.sin(2 * np.pi * np.arange(weeks) / 52) + rng.normal(0, 1, weeks)
    pred, got = _fit_forecast(y, rng.normal(size=(weeks, 6)), int(weeks * 0.8), 52)
    assert got == status and np.isfinite(pred).all() and len(pred) == weeks - int(weeks * 0.8)
    with pytest.raises(ValueError, match="short"):
        _fit_forecast(y[:70], np.zeros((70, 6)), 56, 52)


def test_series_forecaster_beats_naive_on_seasonal_series():
    rng = np.random.default_rng(4)
    t = np.arange(260)
    y = 1000 + 2 * t + 300 * np.sin(2 * np.pi * t / 52) + rng.normal(0, 5, len(t))
    ex = np.zeros((len(t), 1))
    split = 208
    pred, status = _fit_forecast(y, ex, split, 52)
    assert status == "full"
    mae = np.abs(pred - y[split:]).mean()
    naive = np.abs(y[split - 52:len(t) - 52] - y[split:]).mean()
    assert mae < naive
