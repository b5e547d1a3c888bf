"""Registered streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storecast.functions.scalar import rnd

from storecast.plans.registry import register
from storecast.streaming import events as ST


@register("k13_stream_window_counts", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, COUNT(*) AS events,
       ROUND(SUM(value), 6) AS value_sum
FROM events GROUP BY 1, 2""")
def k13_stream_window_counts(spark, sf_dir):
    """Event-time daily windows per event type from a Structured Streaming query."""
    r = ST.window_counts(spark, sf_dir, "1 day")
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events",
                    rnd("value_sum", 6).alias("value_sum"))


@register("k13_minibatch_centroids")
def k13_minibatch_centroids(spark, sf_dir):
    """Streaming mini-batch cluster centroids over (value, hour) with decayed-mean updates."""
    return ST.minibatch_centroids(spark, sf_dir, k=4, decay=0.5)
