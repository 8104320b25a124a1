"""Stored features, parameters, predictions and summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Feature rows by year; the repartition gives each year few large files. The schema is
    kept beside them, for formats that hold text only."""
    d = df.withColumn("year", F.year("delivery_date"))
    d.repartition("year", "delivery_date").write.mode("overwrite").partitionBy("year").option(
        "header", "true"
    ).format(fmt).save(path)
    df.sparkSession.createDataFrame([(d.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/_schema")


def read_features(
    spark: SparkSession, path: str, years: list[int] | None = None, fmt: str = "parquet", schema=None
) -> DataFrame:
    """Feature rows of the given years; the others are never listed or read. Columns have the
    types they were written with, also in CSV."""
    if schema is None and fmt == "csv":
        schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_schema").head()[0]))
    r = spark.read.format(fmt).option("header", "true")
    d = (r.schema(schema) if schema is not None else r).load(path)
    return d.filter(F.col("year").isin(years)) if years else d


def save_params(df: DataFrame, path: str, config: dict | None = None) -> None:
    """Fitted parameters with nested arrays, plus the run's configuration."""
    text = json.dumps(config or {}, sort_keys=True, default=str)
    df.withColumn("config", F.lit(text)).write.mode("overwrite").partitionBy(
        "which_hour_before"
    ).parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def get_params(params: DataFrame, keys: DataFrame) -> DataFrame:
    """Parameters of each (date, hour, which_hour_before), with a status: 'ok',
    'failed' (with its error) or 'missing'."""
    on = ["date", "hour", "which_hour_before"]
    found = keys.select(*on).distinct().join(params.withColumn("_hit", F.lit(True)), on, "left")
    status = (
        F.when(F.col("_hit").isNull(), "missing")
        .when(F.col("calibration_ok"), "ok")
        .otherwise("failed")
    )
    return found.withColumn("status", status).drop("_hit")


def write_predictions(df: DataFrame, path: str, chunk: str | None = None, fmt: str = "csv") -> None:
    """Predictions by date, sorted inside each file."""
    d = df.withColumn("chunk_id", F.lit(chunk)) if chunk is not None else df
    (
        d.repartition("date")
        .sortWithinPartitions("date", "hour", "which_hour_before", "timestamp")
        .write.mode("overwrite")
        .option("header", "true")
        .partitionBy("date")
        .format(fmt)
        .save(path)
    )


def write_summary(df: DataFrame, path: str) -> None:
    """A summary table (one row per model) as a single CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
