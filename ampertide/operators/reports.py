"""Prediction normalisation, error tables, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_predictions(df: DataFrame, source: str | None = None) -> DataFrame:
    """One schema for both prediction vintages: hour in 0..23, horizon given or
    ceil(ttd/4) in 1..4, numeric errors, log-score as a loss, and a source label.

    The vintage with abs_err/sq_err stores log density; its sign is turned."""
    have = set(df.columns)
    if "hour" not in have:
        raise ValueError("predictions need a column 'hour'")
    if {"abs_error", "sq_error"} <= have:
        ae, se, sign = "abs_error", "sq_error", 1.0
    elif {"abs_err", "sq_err"} <= have:
        ae, se, sign = "abs_err", "sq_err", -1.0
    else:
        raise ValueError("predictions need (abs_error, sq_error) or (abs_err, sq_err)")

    def num(c: str) -> Column:
        return F.col(c).try_cast("double")

    def clip(c: Column, lo: int, hi: int) -> Column:
        # Nulls stay null: greatest/least would drop them.
        return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)).cast("int"))

    if "which_hour_before" in have:
        wh = clip(num("which_hour_before"), 1, 4)
    elif "ttd" in have:
        wh = clip(F.ceil(num("ttd") / 4), 1, 4)
    else:
        wh = F.lit(None).cast("int")
    label = F.lit(source) if source else F.col("source")
    return df.select(
        label.alias("source"),
        clip(num("hour"), 0, 23).alias("hour"),
        wh.alias("which_hour_before"),
        num(ae).alias("abs_error"),
        num(se).alias("sq_error"),
        (num("log_score") * sign if "log_score" in have else F.lit(None).cast("double")).alias("log_score"),
        (num("crps") if "crps" in have else F.lit(None).cast("double")).alias("crps"),
    ).na.drop(subset=["abs_error", "sq_error"])


def error_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """MAE and RMSE by any keys; null keys are a group."""
    return df.groupBy(*keys).agg(
        F.avg("abs_error").alias("MAE"),
        F.sqrt(F.greatest(F.avg("sq_error"), F.lit(0.0))).alias("RMSE"),
    )


def error_levels(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """The tables of error_by for several sets of keys, in one scan: `level` names the set a row belongs
    to, and keys outside of it are null. A null key of a level is a group of its own, told apart from a key
    outside of it by the grouping id."""
    keys = list(dict.fromkeys(k for ks in levels.values() for k in ks))
    # Bit k - 1 - i of the grouping id is set where key i is outside of the set.
    ids = {name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in ks) for name, ks in levels.items()}
    if len(set(ids.values())) < len(ids):
        raise ValueError("two levels have the same keys")
    out = df.groupingSets([[F.col(k) for k in ks] for ks in levels.values()], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("MAE"),
        F.sqrt(F.greatest(F.avg("sq_error"), F.lit(0.0))).alias("RMSE"),
    )
    level = F.coalesce(*[F.when(F.col("_id") == i, name) for name, i in ids.items()])
    return out.select(level.alias("level"), *keys, "n", "MAE", "RMSE")


def model_order(source: str = "source") -> list[Column]:
    """Multivariate-t models first, then by name."""
    return [(~F.upper(F.col(source)).startswith("MVT")).asc(), F.col(source).asc()]


def summary_table(df: DataFrame) -> DataFrame:
    out = df.groupBy("source").agg(
        F.avg("abs_error").alias("MAE"),
        F.sqrt(F.avg("sq_error")).alias("RMSE"),
        F.avg("log_score").alias("LogScore"),
        F.avg("crps").alias("CRPS"),
    )
    return out.orderBy(*model_order())


def summarize(df: DataFrame) -> DataFrame:
    """Study summary by (horizon, hour, method)."""
    return df.groupBy("which_hour_before", "hour", "method").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("abs_error").alias("MAE"),
        F.sqrt(F.avg("sq_error")).alias("RMSE"),
        F.avg("log_score").alias("log_score"),
        F.avg("crps").alias("crps"),
    )


def complete_axis(df: DataFrame, col: str, values: list[int], per: list[str]) -> DataFrame:
    """One row per (per, value), null where there is no data.

    The axis is an array beside each key, exploded; no cross join."""
    axis = df.select(*per).distinct().select(
        *per, F.explode(F.array(*[F.lit(v) for v in values])).alias(col)
    )
    return axis.join(df, [*per, col], "left")
