"""Shared helpers: written intermediate tables, text columns and fold hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storecast.session import ship_package

#: One run of white space inside a text, as a Java regular expression.
WHITE = r"[\x20\x09-\x0D]"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local master (tests) may go without; it gets a temporary folder once per session.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="storecast-llm-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bounded_batches(spark: SparkSession) -> None:
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size: some hundred rows, and 16 MB of long texts.

    The limits are session settings and are left alone where the user has set them.
    """
    _bounded_batches(df.sparkSession)
    ship_package(df.sparkSession)  # for workers that don't have the package
    return df.mapInArrow(run, schema)


def map_pandas(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInPandas`` with batches bounded as in ``map_arrow``."""
    _bounded_batches(df.sparkSession)
    ship_package(df.sparkSession)
    return df.mapInPandas(run, schema)


def fold(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets`` (null id: 0, so such rows are never learnt from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(buckets), F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except (TypeError, ValueError):
        return 200


#: A key is split in a join if it has more rows than both this and a quarter of a partition's share.
LEAST_SPLIT = 64


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], spread: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``counted``, a written table of one row for each key with its number ``n`` of rows.

    A key of more than a quarter of a partition's share of rows is split, by the hash of the column ``spread``, over
    as many places as such quarters. There are fewer than four such keys for each partition, so their list may be
    broadcast, whatever the size of the tables. ``total``: the number of rows, if known.
    """
    if total is None:
        total = counted.agg(F.sum("n")).head()[0] or 0
    most = max(LEAST_SPLIT, total // (4 * shuffle_partitions(rows.sparkSession)))
    places = F.ceil(F.col("n") / F.lit(most)).cast("int")
    hot = counted.where(F.col("n") > most).select(*keys, places.alias("__places"))
    own = F.pmod(F.xxhash64(spread), F.coalesce("__places", F.lit(1))).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("__place", own).drop("__places")
    right = counted.withColumn("__place", F.explode(F.sequence(F.lit(0), places - 1)))
    return left.join(right, [*keys, "__place"]).drop("__place")
