"""A rolling study in parts that can be stopped and taken up again.

A part is (horizon, run of whole day blocks). Its parameters and predictions are written to
partitions of their own, then one row in the manifest says that it is finished. A run fits what the
manifest does not hold; a part that was cut off half way is fitted again and replaces its partition."""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import summarize
from .mvt import StudyConfig, effective_start, fit_mvt, predict_mvt, score_density, study_rows

MANIFEST = "wh int, part int, first_day date, last_day date, config string"
EPOCH = dt.date(1970, 1, 1)


def _fingerprint(cfg: StudyConfig, blocks_per_part: int) -> str:
    """What a part's rows depend on, but for the days, which the manifest holds part by part."""
    return hashlib.sha256(repr((replace(cfg, first_day=None, last_day=None), blocks_per_part)).encode()).hexdigest()


def finished_parts(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def wanted_parts(df: DataFrame, cfg: StudyConfig, blocks_per_part: int) -> DataFrame:
    """Manifest rows of the whole study: the parts with target days, and those days' ends."""
    first = effective_start(df, cfg)
    days = df.select(F.col("delivery_date").alias("day")).distinct().filter(F.col("day") >= F.lit(first))
    if cfg.last_day:
        days = days.filter(F.col("day") <= F.lit(cfg.last_day).cast("date"))
    part = F.floor(F.unix_date("day") / (cfg.block_days * blocks_per_part)).cast("int")
    ends = days.groupBy(part.alias("part")).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    wh = F.explode(F.array(*[F.lit(h) for h in cfg.horizons])).alias("wh")
    return ends.select(wh, "part", "first_day", "last_day", F.lit(_fingerprint(cfg, blocks_per_part)).alias("config"))


def run_parts(df: DataFrame, cfg: StudyConfig, folder: str, blocks_per_part: int = 12, at_most: int | None = None) -> int:
    """Fits, predicts and writes the parts that `folder` lacks, at most so many; returns how many were done.

    A part whose days have changed (new data at the end) is done again. A folder holds one
    configuration; another one is an error. Parts of one horizon follow in time; each is one job
    over all its hours and days, so make parts large where the cluster is."""
    spark = df.sparkSession
    done, wanted = finished_parts(spark, folder), wanted_parts(df, cfg, blocks_per_part)
    if not done.filter(F.col("config") != _fingerprint(cfg, blocks_per_part)).isEmpty():
        raise ValueError(f"{folder} holds a study with another configuration")
    # Days / (block_days * blocks_per_part) rows per horizon: bounded by the calendar.
    todo = sorted(wanted.join(done, wanted.columns, "left_anti").collect(), key=lambda r: (-r.wh, r.part))[:at_most]
    if not todo:
        return 0
    rows_of = study_rows(df, replace(cfg, horizons=tuple(h for h in cfg.horizons if h in {r.wh for r in todo})))
    reach = cfg.lookback_days + (1 if cfg.extra_day else 0)
    for r in todo:
        names, rows = rows_of[r.wh]
        day = F.col("delivery_date")
        near = rows.filter((day >= F.lit(r.first_day - dt.timedelta(reach))) & (day <= F.lit(r.last_day)))
        fit = fit_mvt(
            near, names, cfg.lookback_days, cfg.method, cfg.block_days, cfg.extra_day, r.first_day.isoformat(), r.last_day.isoformat()
        )
        _replace(fit, f"{folder}/params", r)
        # Read back with its schema: a part without fits has no partition to infer one from.
        kept = spark.read.schema(fit.schema).parquet(f"{folder}/params/wh={r.wh}/part={r.part}")
        _replace(score_density(predict_mvt(near.filter(day >= F.lit(r.first_day)), kept, names)), f"{folder}/predictions", r)
        spark.createDataFrame([tuple(r)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return len(todo)


def _replace(out: DataFrame, path: str, part) -> None:
    """Overwrites the partition of this part alone."""
    out.write.mode("overwrite").parquet(f"{path}/wh={part.wh}/part={part.part}")


def study_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parameters, scored predictions, summary) of the finished parts."""
    done = finished_parts(spark, folder).select("wh", "part").distinct()

    def table(name):
        found = spark.read.option("mergeSchema", "false").parquet(f"{folder}/{name}")
        return found.join(done, ["wh", "part"], "left_semi").drop("wh", "part")

    preds = table("predictions")
    return table("params"), preds, summarize(preds)
