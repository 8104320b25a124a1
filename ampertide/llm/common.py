"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampertide.session import scratch_path

# Rows in one Arrow batch. Texts average a few kilobytes but may be very long, so a
# batch stays small enough for a worker to hold several of them.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; batches to Python workers are kept short."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A text column as a string, null counting as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def packed_row(df: DataFrame) -> Column:
    """All columns of a frame in one struct, so that helper columns beside it cannot clash
    with columns of the table."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(df: DataFrame, schema: T.StructType, column: str = "row") -> DataFrame:
    return df.select(*[F.col(f"`{column}`.`{f.name}`").alias(f.name) for f in schema.fields])


def written(df: DataFrame) -> DataFrame:
    """Like session.cut, in the denser of Spark's common codecs: for tables that hold texts."""
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
