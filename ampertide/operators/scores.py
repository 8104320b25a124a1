"""Scores that need an order over many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_total


def pairwise_spread(df: DataFrame, keys: list[str], value: str, cell: Column) -> DataFrame:
    """Half of E|X - X'| over the draws of each key: sum((2r - n - 1) x_r) / n^2.

    Equal draws collapse to a count; ranks run over cells, so one key may hold any
    number of draws."""
    ties = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("m"))
    cum = running_total(ties, keys, [value], ["m"], cell)
    # Ranks of m equal draws sum to m * cum - m (m - 1) / 2.
    m, c, n = F.col("m"), F.col("cum_m"), F.col("tot_m")
    rank_sum = m * c - m * (m - 1) / 2
    term = (2 * rank_sum - m * (n + 1)) * F.col(value)
    return cum.groupBy(*keys).agg(
        (F.sum(term) / (F.max(n).cast("double") * F.max(n))).alias("half_spread"),
        F.max(n).alias("n"),
    )


def ensemble_crps_rows(
    draws: DataFrame, keys: list[str], value: str, observed: str, cell: Column
) -> DataFrame:
    """Ensemble CRPS per key from one row per draw."""
    near = draws.groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col(observed))).alias("_d"))
    spread = pairwise_spread(draws, keys, value, cell)
    return near.join(spread, keys).select(*keys, (F.col("_d") - F.col("half_spread")).alias("crps"))
