"""Session settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime re-planning does the partition sizing, the skew splitting and the
# choice of broadcast joins from measured sizes; nothing is hinted by hand.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Plans here have thousands of column expressions; recording the Python line of
    # each one costs more than small queries do.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(app: str = "ampertide") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        builder()
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names in spark.checkpoint.dir. Only a local master may go
    without: there one machine's folder is shared by all tasks. Elsewhere executors would
    write to their own disks, so an unset folder is an error."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="ampertide-ckpt-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared checkpoint folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df):
    """Writes a frame as a table in the shared folder and reads it back.

    Ends the lineage, survives lost executors, computes once, and gives the planner
    the real size for its join choices."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df, *keys: str):
    """Hash-partitions by the keys over spark.sql.shuffle.partitions tasks.

    For heavy per-group work on few bytes: a stated number keeps runtime coalescing,
    which only sees bytes, from packing all groups into one task. The grouping that
    follows reuses this partitioning."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
