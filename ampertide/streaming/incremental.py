"""Incremental statistics as streaming jobs.

Each micro-batch is reduced to a few mergeable sums per key and written under its
batch id; a replayed batch overwrites its own part, so every row counts once. Parts are
folded in tiers (`tiers`), so a look at the state reads a number of parts that grows with
the logarithm of the number of batches. Nothing is kept on one machine."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..models.linear import path_from_gram
from ..operators.ordered import join_null_safe, running_total
from . import tiers


def _decay(df: DataFrame, by: list[str], order: list[str], cell: Column, forget: float) -> DataFrame:
    """Adds _w = (1-forget)^(rows of the key after this one in the batch) and marks the
    first row of the key."""
    d = running_total(df.withColumn("_one", F.lit(1).cast("long")), by, order, ["_one"], cell)
    after = F.col("tot__one") - F.col("cum__one")
    return d.withColumn("_w", F.pow(F.lit(1.0 - forget), after.cast("double"))).withColumn(
        "_head", F.col("cum__one") == 1
    )


def scaler_part(
    df: DataFrame, cols: list[str], by: list[str], forget: float = 0.0,
    order: list[str] = (), cell: Column | None = None,
) -> DataFrame:
    """Mergeable sums of one batch: n, and per column mean and M2 (forget 0) or decayed
    sums and the first value."""
    by = list(by)
    if forget == 0:
        aggs = [F.count(F.lit(1)).alias("n")]
        for c in cols:
            aggs += [
                F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"),
                (F.var_pop(c) * F.count(c)).alias(f"m2_{c}"),
            ]
        return df.groupBy(*by).agg(*aggs)
    d = _decay(df, by, list(order), cell, forget)
    # Sums are about the batch's first value per key, one small row each: a large level
    # does not cancel the digits of the spread.
    heads = d.filter("_head").select(*by, *[F.col(c).cast("double").alias(f"first_{c}") for c in cols])
    d = join_null_safe(d, heads, by) if by else d.withColumns({f"first_{c}": heads.select(f"first_{c}").scalar() for c in cols})
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        dev = F.col(c) - F.col(f"first_{c}")
        aggs += [
            F.sum(F.when(dev.isNotNull(), F.col("_w") * forget)).alias(f"s0_{c}"),
            F.sum(F.col("_w") * forget * dev).alias(f"s1_{c}"),
            F.sum(F.col("_w") * forget * dev * dev).alias(f"s2_{c}"),
            F.max(f"first_{c}").alias(f"first_{c}"),
        ]
    return d.groupBy(*by).agg(*aggs)


def _rows_after(parts: DataFrame, by: list[str]) -> DataFrame:
    # One row per key and batch.
    w = W.partitionBy(*by)
    later = w.orderBy(F.desc("batch")).rowsBetween(W.unboundedPreceding, -1)
    return parts.select(
        "*",
        F.coalesce(F.sum("n").over(later), F.lit(0)).cast("double").alias("_after"),
        F.sum("n").over(w).cast("double").alias("_total"),
        (F.row_number().over(w.orderBy("batch")) == 1).alias("_opening"),
    )


def fold_scaler(parts: DataFrame, cols: list[str], by: list[str], forget: float = 0.0) -> DataFrame:
    """One part per key from parts that follow each other in the order of `batch`."""
    by = list(by)
    key = W.partitionBy(*by)  # one row per key and part
    if forget == 0:
        d = parts.withColumns(
            {f"_all_{c}": F.sum(F.col(f"n_{c}") * F.col(f"mean_{c}")).over(key) / F.sum(f"n_{c}").over(key) for c in cols}
        )
        aggs = [F.sum("n").alias("n")]
        for c in cols:
            n, off = F.col(f"n_{c}"), F.col(f"mean_{c}") - F.col(f"_all_{c}")
            within = F.sum(F.coalesce(f"m2_{c}", F.lit(0.0)) + F.coalesce(n * off * off, F.lit(0.0)))
            aggs += [F.sum(n).alias(f"n_{c}"), F.max(f"_all_{c}").alias(f"mean_{c}"), within.alias(f"m2_{c}")]
        return d.groupBy(*by).agg(*aggs)
    d = _rows_after(parts, by)
    # All sums move to the first value of the opening part.
    d = d.withColumns({f"_base_{c}": F.max(F.when(F.col("_opening"), F.col(f"first_{c}"))).over(key) for c in cols})
    fade = F.pow(F.lit(1.0 - forget), F.col("_after"))
    aggs = [F.sum("n").alias("n")]
    for c in cols:
        off = F.col(f"first_{c}") - F.col(f"_base_{c}")
        s0, s1, s2 = (F.col(f"s{i}_{c}") for i in range(3))
        aggs += [
            F.sum(fade * s0).alias(f"s0_{c}"), F.sum(fade * (s1 + s0 * off)).alias(f"s1_{c}"),
            F.sum(fade * (s2 + 2.0 * off * s1 + s0 * off * off)).alias(f"s2_{c}"), F.max(f"_base_{c}").alias(f"first_{c}"),
        ]
    return d.groupBy(*by).agg(*aggs)


def merge_scaler(parts: DataFrame, cols: list[str], by: list[str], forget: float = 0.0) -> DataFrame:
    """n, mean_<c> and var_<c> (population, or exponentially weighted) per key."""
    whole = fold_scaler(parts, cols, by, forget)
    out = [F.col(c) for c in by] + [F.col("n")]
    for c in cols:
        if forget == 0:
            out += [F.col(f"mean_{c}"), F.try_divide(f"m2_{c}", f"n_{c}").alias(f"var_{c}")]
        else:
            s1 = F.col(f"s1_{c}")
            out += [(F.col(f"first_{c}") + s1).alias(f"mean_{c}"), (F.col(f"s2_{c}") - s1 * s1).alias(f"var_{c}")]
    return whole.select(*out)


def stream_scaler(
    stream: DataFrame, cols: list[str], by: list[str], path: str, checkpoint: str,
    forget: float = 0.0, order: list[str] = (), cell: Column | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Keeps mean and variance of `cols` per key up to date under `path`."""

    def absorb(batch: DataFrame, batch_id: int) -> None:
        part = scaler_part(batch, cols, by, forget, order, cell)
        tiers.absorb(part, path, batch_id, lambda parts: fold_scaler(parts, cols, by, forget))

    return _start(stream, absorb, checkpoint, available_now)


def read_scaler(
    spark: SparkSession, path: str, cols: list[str], by: list[str], forget: float = 0.0
) -> DataFrame:
    return merge_scaler(tiers.state(spark, path), cols, by, forget)


def gram_part(
    df: DataFrame, xs: list[str], y: str, by: list[str], w: str | None = None, forget: float = 0.0,
    order: list[str] = (), cell: Column | None = None,
) -> DataFrame:
    """Weighted Gram sums of one batch, decayed along the order when forget > 0."""
    from ..operators.stats import gram

    if forget == 0:
        return gram(df, xs, y, w, list(by))
    d = _decay(df, list(by), list(order), cell, forget)
    d = d.withColumn("_wt", F.col("_w") * (F.col(w) if w else F.lit(1.0)))
    return gram(d, xs, y, "_wt", list(by))


def merge_gram(parts: DataFrame, k: int, by: list[str], forget: float = 0.0) -> DataFrame:
    """One part per key from parts that follow each other in the order of `batch`."""
    names = ["sum_w", "yy"] + [f"xy_{i}" for i in range(k)]
    names += [f"g_{i}_{j}" for i, j in combinations_with_replacement(range(k), 2)]
    if forget == 0:
        fade, d = F.lit(1.0), parts
    else:
        d = _rows_after(parts, list(by))
        fade = F.pow(F.lit(1.0 - forget), F.col("_after"))
    return d.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(fade * F.col(c)).alias(c) for c in names])


def _with_const(df: DataFrame, xs: list[str]) -> tuple[DataFrame, list[str]]:
    return df.withColumn("_const", F.lit(1.0)), ["_const", *xs]


def stream_gram(
    stream: DataFrame, xs: list[str], y: str, by: list[str], path: str, checkpoint: str,
    w: str | None = None, forget: float = 0.0, order: list[str] = (), cell: Column | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Keeps X'WX and X'Wy per key up to date under `path`."""

    def absorb(batch: DataFrame, batch_id: int) -> None:
        part = gram_part(batch, xs, y, by, w, forget, order, cell)
        tiers.absorb(part, path, batch_id, lambda parts: merge_gram(parts, len(xs), by, forget))

    return _start(stream, absorb, checkpoint, available_now)


def read_gram(spark: SparkSession, path: str, k: int, by: list[str], forget: float = 0.0) -> DataFrame:
    return merge_gram(tiers.state(spark, path), k, by, forget)


def stream_lasso_refit(
    stream: DataFrame, xs: list[str], y: str, by: list[str], path: str, checkpoint: str,
    forget: float = 0.0, order: list[str] = (), cell: Column | None = None,
    n_lambda: int = 50, available_now: bool = True,
) -> StreamingQuery:
    """After each batch adds its Gram sums and refits the lasso path, starting from the
    path of the batch before. Paths lie under path/paths, sums under path/sums."""
    k = len(xs) + 1
    free = [True] + [False] * len(xs)
    by = list(by)

    def absorb(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        d, cols = _with_const(batch, xs)
        part = gram_part(d, cols, y, by, None, forget, order, cell)
        tiers.absorb(part, f"{path}/sums", batch_id, lambda parts: merge_gram(parts, k, by, forget))
        sums = tiers.state(spark, f"{path}/sums", batch_id)
        from ..models.linear import gram_arrays

        stats = gram_arrays(merge_gram(sums, k, by, forget), k)
        if batch_id > 0:
            prev = spark.read.parquet(f"{path}/paths/batch={batch_id - 1}")
            # n_lambda steps per key.
            warm = prev.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("step", "beta"))).alias("_p"))
            warm = warm.select(*by, F.transform("_p", lambda e: e["beta"]).alias("_start"))
            stats = stats.join(warm, by, "left")
            fit = path_from_gram(stats, k, by, free, n_lambda, start="_start")
        else:
            fit = path_from_gram(stats, k, by, free, n_lambda)
        fit.write.mode("overwrite").parquet(f"{path}/paths/batch={batch_id}")

    return _start(stream, absorb, checkpoint, available_now)


def _start(stream: DataFrame, absorb, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_path(spark: SparkSession, path: str) -> DataFrame:
    """Lasso path of the newest batch."""
    d = spark.read.parquet(f"{path}/paths")
    top = d.agg(F.max("batch")).scalar()
    return d.filter(F.col("batch") == top).drop("batch")
