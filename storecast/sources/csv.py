"""A1-A3 CSV scans of the reference's input layout; A5/A6 CSV sinks.

Schemas are explicit (no inference pass over the data). Dates are
day-first text (``dd/MM/yyyy``); ``NA`` marks missing values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALES_SCHEMA = T.StructType([
    T.StructField("Store", T.IntegerType()), T.StructField("Dept", T.StringType()),
    T.StructField("Date", T.DateType()), T.StructField("Weekly_Sales", T.DoubleType()),
    T.StructField("IsHoliday", T.BooleanType())])

FEATURES_SCHEMA = T.StructType(
    [T.StructField("Store", T.IntegerType()), T.StructField("Date", T.DateType()),
     T.StructField("Temperature", T.DoubleType()), T.StructField("Fuel_Price", T.DoubleType())]
    + [T.StructField(f"MarkDown{i}", T.DoubleType()) for i in range(1, 6)]
    + [T.StructField("CPI", T.DoubleType()), T.StructField("Unemployment", T.DoubleType()),
       T.StructField("IsHoliday", T.BooleanType())])

STORES_SCHEMA = T.StructType([T.StructField("Store", T.IntegerType()), T.StructField("Type", T.StringType()),
                              T.StructField("Size", T.LongType())])

# Reference column names -> panel column names.
PANEL_NAMES = {"Store": "store", "Dept": "dept", "Date": "week", "Weekly_Sales": "weekly_sales",
               "IsHoliday": "is_holiday", "Temperature": "temperature", "Fuel_Price": "fuel_price",
               "MarkDown1": "markdown1", "MarkDown2": "markdown2", "MarkDown3": "markdown3",
               "MarkDown4": "markdown4", "MarkDown5": "markdown5", "CPI": "cpi",
               "Unemployment": "unemployment", "Type": "type", "Size": "size"}


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("dateFormat", "dd/MM/yyyy")
            .option("nullValue", "NA").option("mode", "FAILFAST").csv(path))


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """A1 — fact table: Store, Dept, Date, Weekly_Sales, IsHoliday."""
    return _read(spark, path, SALES_SCHEMA)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A2 — store-week features; ``NA`` -> NULL."""
    return _read(spark, path, FEATURES_SCHEMA)


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    """A3 — store dimension (a missing final newline is fine for the CSV reader)."""
    return _read(spark, path, STORES_SCHEMA)


def to_panel_names(df: DataFrame) -> DataFrame:
    """Rename reference columns to the panel's snake-case names (holiday as 0/1)."""
    for a, b in PANEL_NAMES.items():
        if a in df.columns:
            df = df.withColumnRenamed(a, b)
    if "is_holiday" in df.columns:
        df = df.withColumn("is_holiday", F.col("is_holiday").cast("int"))
    return df


def to_reference_layout(panel_sales: DataFrame) -> DataFrame:
    """Panel sales rows in the reference's sales layout (for writing CSV inputs)."""
    return panel_sales.select(F.col("store").alias("Store"), F.col("dept").alias("Dept"),
                              F.col("week").alias("Date"), F.col("weekly_sales").alias("Weekly_Sales"),
                              (F.col("is_holiday") == 1).alias("IsHoliday"))


def features_reference_layout(features: DataFrame) -> DataFrame:
    """Panel features in the reference's features layout (IsHoliday from the ISO week rule)."""
    from storecast.sources.panel import HOLIDAY_WEEKS
    return features.select(
        F.col("store").alias("Store"), F.col("week").alias("Date"), F.col("temperature").alias("Temperature"),
        F.col("fuel_price").alias("Fuel_Price"), *[F.col(f"markdown{i}").alias(f"MarkDown{i}") for i in range(1, 6)],
        F.col("cpi").alias("CPI"), F.col("unemployment").alias("Unemployment"),
        F.weekofyear("week").isin(*HOLIDAY_WEEKS).alias("IsHoliday"))


def stores_reference_layout(stores: DataFrame) -> DataFrame:
    return stores.select(F.col("store").alias("Store"), F.col("type").alias("Type"), F.col("size").alias("Size"))


def write_table(df: DataFrame, path: str, fmt: str = "csv", index_col: str | None = None,
                single_file: bool = False) -> None:
    """A5/A6 — write a result table with a header; ``index_col`` first (the leaderboard's model name).

    ``single_file`` coalesces to one part file and is meant for small
    reports only (a leaderboard, top rules); large tables keep their
    partitioning.
    """
    if index_col:
        df = df.select(index_col, *[c for c in df.columns if c != index_col])
    if single_file:
        df = df.coalesce(1)
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("dateFormat", "dd/MM/yyyy").option("nullValue", "NA").csv(path)
    else:
        w.format(fmt).save(path)
