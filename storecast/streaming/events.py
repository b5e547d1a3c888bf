"""K13 — Structured Streaming over the ``events`` table.

* ``window_counts``: event-time tumbling windows with a watermark, in
  update mode; every micro-batch appends its updated window rows to a
  table, and the final value of a window is its row from the latest batch.
* ``minibatch_centroids``: mini-batch cluster updates in ``foreachBatch``;
  the centroid state (k rows) lives in a table in the shared checkpoint
  folder and is merged with a decayed mean after each batch.

Both read the stream from the events parquet file and end with an
``availableNow`` trigger, so a run processes everything present and stops.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storecast.operators.planning import nearest_centroid
from storecast.session import ensure_checkpoint_dir


def _work_dir(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/streams/{name}-{uuid.uuid4().hex[:12]}"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream of the ``events`` rows, one file or a folder of part files (the file source needs the schema up front)."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    # a pattern, as the stream takes a folder or what a pattern matches, but not the path of one file
    return (spark.readStream.schema(spark.read.parquet(path).schema)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[t]"))


def window_counts(spark: SparkSession, sf_dir: str, window: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Per event-time window and event type: events and summed value.

    Without a watermark every row counts, in whatever order the files come; the state is one row per
    window and type. With one, windows older than it are dropped from the state and later rows for them are lost.
    """
    work = _work_dir(spark, "window-counts")
    # watermarks need TIMESTAMP event time; the table stores wall-clock TIMESTAMP_NTZ (session time zone UTC)
    rows = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    agg = (rows.groupBy(F.window("ts", window).alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("w.start").alias("window_start"), "event_type", "events", "value_sum",
                      F.lit(batch_id).alias("batch_id"))
         .write.mode("append").parquet(f"{work}/updates"))

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    ups = spark.read.parquet(f"{work}/updates")
    latest = Window.partitionBy("window_start", "event_type").orderBy(F.col("batch_id").desc())
    return (ups.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") == 1)
            .select("window_start", "event_type", "events", "value_sum"))


def minibatch_centroids(spark: SparkSession, sf_dir: str, k: int = 4, decay: float = 0.5,
                        cols=("value", "hour")) -> DataFrame:
    """Mini-batch KMeans over event vectors (value, hour of day) with decayed-mean updates."""
    work = _work_dir(spark, "centroids")
    state_path = f"{work}/state"
    cols = list(cols)
    stream = event_stream(spark, sf_dir).select("event_id", F.col("value").cast("double").alias("value"),
                                                F.hour("ts").cast("double").alias("hour"))
    last = {"batch": None}

    def update(batch: DataFrame, batch_id: int) -> None:
        # state of batch b lives at state/b<b>: a replayed batch rewrites the same version
        pts = batch.where(F.col("value").isNotNull())
        if batch_id == 0:
            state = (pts.withColumn("_h", F.xxhash64("event_id", F.lit(batch_id))).orderBy("_h").limit(k)
                     .withColumn("cluster", F.row_number().over(Window.orderBy("_h")) - 1)
                     .select("cluster", *cols, F.lit(0.0).alias("weight")))
        else:
            state = spark.read.parquet(f"{state_path}/b{batch_id - 1}")
        assigned = nearest_centroid(pts, state, cols, "cluster", out="cluster")
        stats = assigned.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("bn"),
                                                *[F.sum(c).alias(f"bs_{c}") for c in cols])
        old_w = F.col("weight") * F.lit(decay)
        merged = state.join(stats, "cluster", "left").fillna(0.0, subset=["bn"] + [f"bs_{c}" for c in cols])
        new = merged.select(
            "cluster",
            *[F.when(old_w + F.col("bn") > 0, (old_w * F.col(c) + F.col(f"bs_{c}")) / (old_w + F.col("bn")))
              .otherwise(F.col(c)).alias(c) for c in cols],
            (old_w + F.col("bn")).alias("weight"))
        new.write.mode("overwrite").parquet(f"{state_path}/b{batch_id}")
        last["batch"] = batch_id

    q = (stream.writeStream.foreachBatch(update).option("checkpointLocation", f"{work}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{state_path}/b{last['batch']}")
