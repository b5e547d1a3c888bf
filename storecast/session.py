"""Session helpers: a tuned local/cluster session and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "storecast") -> SparkSession:
    """Return a session with AQE, UTC time and the web UI off.

    On a cluster pass ``master=None`` and let the launcher decide; the
    remaining settings are the ones every job here relies on.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("STORECAST_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions or master:  # a cluster's own setting stands unless a number is asked for
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.cpu_count() or 8))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local master (tests) may go without."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="storecast-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    value = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        return max(1, int(value))
    except (TypeError, ValueError):
        return 200


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each Spark context.

    Needed wherever the package is not installed on the workers (no ``--py-files``).
    """
    sc = spark.sparkContext
    if getattr(sc, "_storecast_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="storecast-zip-"), "storecast.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("storecast", os.path.relpath(path, here)))
    sc.addPyFile(target)
    sc._storecast_shipped = True
