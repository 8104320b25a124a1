"""Trade tape: cleaning, products, dedupe, tick statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import minutes_between, to_instant, to_local, trunc_hour
from ..functions.numeric import vwap

PRODUCT_MINUTES = {"hourly": 60, "half_hourly": 30, "quarterly": 15}


def clean_tape(trades: DataFrame) -> DataFrame:
    """Continuous-phase trades that are not self-trades, where the columns exist.

    An unknown (null) self-trade flag is kept."""
    if "trade_phase" in trades.columns:
        trades = trades.filter(F.col("trade_phase") == "CONT")
    if "self_trade" in trades.columns:
        trades = trades.filter(~F.col("self_trade").eqNullSafe("Y"))
    return trades


def with_duration(trades: DataFrame) -> DataFrame:
    return trades.withColumn(
        "duration", minutes_between(F.col("delivery_end"), F.col("delivery_start"))
    )


def _is_minutes(duration: Column, target: int) -> Column:
    return F.abs(duration - target) <= 1e-6 + 1e-5 * target


def of_product(trades: DataFrame, product: str, duration: str = "duration") -> DataFrame:
    if product not in PRODUCT_MINUTES:
        raise ValueError(f"unknown product {product}; one of {sorted(PRODUCT_MINUTES)}")
    return trades.filter(_is_minutes(F.col(duration), PRODUCT_MINUTES[product]))


def with_product_type(
    trades: DataFrame, duration: str = "duration", keep_other: bool = False
) -> DataFrame:
    label = F.lit("other")
    for product, minutes in PRODUCT_MINUTES.items():
        label = F.when(_is_minutes(F.col(duration), minutes), product).otherwise(label)
    out = trades.withColumn("product_type", label)
    return out if keep_other else out.filter(F.col("product_type") != "other")


def of_year(df: DataFrame, year: int, col: str = "delivery_start", zone: str | None = None) -> DataFrame:
    """Rows of one year; with a zone the column holds instants and the year is the local one."""
    # A range on the column, not year(col): it reaches the Parquet scan.
    lo, hi = (F.expr(f"TIMESTAMP_NTZ'{y:04d}-01-01 00:00:00'") for y in (year, year + 1))
    if zone:
        lo, hi = to_instant(lo, zone), to_instant(hi, zone)
    return df.filter((F.col(col) >= lo) & (F.col(col) < hi))


def _hour_of(col: str, zone: str | None) -> Column:
    return F.hour(to_local(F.col(col), zone) if zone else F.col(col))


def drop_hours(df: DataFrame, hours: list[int], col: str = "delivery_start", zone: str | None = None) -> DataFrame:
    """Without the given hours of the day; local ones of instants when a zone is given."""
    return df.filter(~_hour_of(col, zone).isin(hours))


def dedupe(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order.

    An ordered aggregate: each map task reduces its copies to one before the
    shuffle, so a key with very many copies costs no more than a rare one."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def tick_vwap(trades: DataFrame) -> DataFrame:
    """One price per contract and execution time; equal prices stay exact."""
    p, q = F.col("price"), F.col("qty_mw")
    return trades.groupBy("delivery_start", "exec_ts").agg(
        F.when(F.min(p) == F.max(p), F.min(p)).otherwise(vwap(p, q)).alias("vwap"),
        F.sum(q).alias("qty_mw"),
    )


def trade_time_counts(trades: DataFrame, hours: DataFrame) -> DataFrame:
    """Distinct trade times per hour of `hours(hour_start)`; empty hours count 0.

    Two plain aggregations (distinct pairs, then a count), both combined map-side."""
    pairs = trades.select(trunc_hour(F.col("exec_ts")).alias("hour_start"), "exec_ts").distinct()
    counts = pairs.groupBy("hour_start").agg(F.count(F.lit(1)).alias("n_times"))
    return hours.join(counts, "hour_start", "left").select(
        "hour_start", F.coalesce("n_times", F.lit(0)).alias("n_times")
    )


def side_volume(trades: DataFrame) -> DataFrame:
    return trades.groupBy("side").agg(F.sum("qty_mw").alias("volume"))


def volume_by_hour(trades: DataFrame, duration: str = "duration", zone: str | None = None) -> DataFrame:
    """Traded volume per delivery hour (local if the starts are instants and a zone is given),
    one column per product type."""
    typed = with_product_type(trades, duration)
    hour = _hour_of("delivery_start", zone).alias("delivery_hour")
    return (
        typed.groupBy(hour)
        .pivot("product_type", list(PRODUCT_MINUTES))
        .agg(F.sum("qty_mw"))
        .na.fill(0.0, list(PRODUCT_MINUTES))
    )


def da_bands(df: DataFrame, price: str, da: str, up: float = 1.3, down: float = 0.7) -> DataFrame:
    lo, hi = F.col(da) * down, F.col(da) * up
    return df.select(
        "*",
        hi.alias("da_upper"),
        lo.alias("da_lower"),
        F.col(price).between(lo, hi).alias("inside_band"),
    )
