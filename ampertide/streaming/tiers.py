"""A log of mergeable parts, merged in tiers.

Batch b writes its part at level 0. Whenever b completes a run of 2^k batches, the two halves of the run
are folded into one part of level k. The state after b is then the fold of one part per binary digit
of b + 1: at most log2(b + 2) parts are read, however long the stream has run. All names follow from
the batch id, so a replayed batch writes the same parts again and every row counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fold = Callable[[DataFrame], DataFrame]


def part_path(path: str, level: int, index: int) -> str:
    return f"{path}/level={level}/part={index}"


def covering(batch: int) -> list[tuple[int, int]]:
    """(level, index) of the parts that hold batches 0 to `batch`, oldest first."""
    out, start, rest = [], 0, batch + 1
    while rest:
        level = rest.bit_length() - 1
        out.append((level, start >> level))
        start += 1 << level
        rest -= 1 << level
    return out


def _read(spark: SparkSession, path: str, parts: list[tuple[int, int]]) -> DataFrame:
    """The parts' rows with `batch`, the first batch that a part holds."""
    out = None
    for level, index in parts:
        d = spark.read.parquet(part_path(path, level, index)).withColumn("batch", F.lit(index << level).cast("long"))
        out = d if out is None else out.unionByName(d)
    return out


def absorb(part: DataFrame, path: str, batch: int, fold: Fold) -> None:
    """Writes the part of a batch and the folds that it completes."""
    spark = part.sparkSession
    part.write.mode("overwrite").parquet(part_path(path, 0, batch))
    level = 1
    while (batch + 1) % (1 << level) == 0:
        index = batch >> level
        halves = _read(spark, path, [(level - 1, 2 * index), (level - 1, 2 * index + 1)])
        fold(halves).write.mode("overwrite").parquet(part_path(path, level, index))
        level += 1


def newest(spark: SparkSession, path: str) -> int:
    """The newest batch whose parts are all written."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def done(level, index):
        return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{part_path(path, level, index)}/_SUCCESS"))

    names = [s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/level=0"))]
    # A batch that is being written has some of its parts missing: the one before is whole.
    for batch in sorted((int(n.removeprefix("part=")) for n in names if n.startswith("part=")), reverse=True):
        if all(done(*p) for p in covering(batch)):
            return batch
    raise FileNotFoundError(f"no finished batch under {path}")


def state(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The parts that make up the state after a batch (the newest by default), with `batch`."""
    return _read(spark, path, covering(newest(spark, path) if batch is None else batch))
