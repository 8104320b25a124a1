"""Tables stored by hash buckets of their join keys, so that lookups between them move no rows.

`write_bucketed` writes Parquet files in buckets to a folder and its layout (schema, keys, number of
buckets) beside them. `open_bucketed` makes such a folder known to any session: two tables with
equal key types and bucket numbers then join, and group by their keys, without an exchange.

Defined results: rows with null keys are kept (in one bucket); an empty table keeps its schema; key
columns must exist, and the folder must be one that all executors share.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYOUT = "_layout"
STUDY_KEYS = ("date", "hour", "which_hour_before")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _register(spark: SparkSession, path: str, layout: dict, name: str) -> None:
    schema = T.StructType.fromJson(layout["schema"])
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    keys = ", ".join(_quoted(k) for k in layout["keys"])
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {_quoted(name)} ({columns}) USING parquet CLUSTERED BY ({keys}) "
        f"SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{where}'"
    )


def write_bucketed(df: DataFrame, path: str, keys: tuple[str, ...] = STUDY_KEYS, buckets: int = 64) -> None:
    """Writes a frame by buckets of its keys: one shuffle, one file per bucket.

    Choose `buckets` so that one holds at most a few hundred MB of the larger table, and the
    same number for all tables that are to meet. The folder must be new or empty."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"no such key column: {', '.join(missing)}")
    spark = df.sparkSession
    layout = {"schema": df.schema.jsonValue(), "keys": list(keys), "buckets": buckets}
    name = f"bucketed_{uuid.uuid4().hex}"
    # The writer hashes as the exchange does, so a task holds whole buckets.
    (
        df.repartition(buckets, *keys)
        .write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    )
    # Only the name goes; the files of a table with a stated place stay.
    spark.sql(f"DROP TABLE {_quoted(name)}")
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{LAYOUT}")


def open_bucketed(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The table of a folder that `write_bucketed` filled, with its buckets known to the planner."""
    layout = json.loads(spark.read.text(f"{path}/{LAYOUT}").head()[0])
    name = name or f"bucketed_{uuid.uuid4().hex}"
    _register(spark, path, layout, name)
    return spark.table(_quoted(name))


def store_panel(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Study rows under the key names that parameters use."""
    named = rows.withColumnsRenamed({"delivery_date": "date", "delivery_hour": "hour", "wh": "which_hour_before"})
    write_bucketed(named.withColumns({"hour": F.col("hour").cast("int"), "which_hour_before": F.col("which_hour_before").cast("int")}), path, STUDY_KEYS, buckets)


def store_params(params: DataFrame, path: str, buckets: int = 64) -> None:
    """Parameters of all horizons, beside a panel stored with as many buckets."""
    write_bucketed(params.withColumns({"hour": F.col("hour").cast("int"), "which_hour_before": F.col("which_hour_before").cast("int")}), path, STUDY_KEYS, buckets)
