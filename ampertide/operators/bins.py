"""Gap-filled VWAP grid per delivery contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import at_hour, effective_start, micros, shift_minutes
from ..functions.numeric import vwap

CONTRACT = ["delivery_date", "delivery_hour"]


def calendar(bounds: DataFrame, hours: int = 24) -> DataFrame:
    """Every (date, hour) between the one row `bounds(first_day, last_day)`.

    The days are spread over the cluster before hours and bins multiply them."""
    days = bounds.select(
        F.explode(F.sequence("first_day", "last_day")).alias("delivery_date")
    ).repartition("delivery_date")
    return days.select(
        "delivery_date",
        F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("delivery_hour"),
    )


def year_calendar(spark, year: int) -> DataFrame:
    return calendar(
        spark.range(1).select(
            F.make_date(F.lit(year), F.lit(1), F.lit(1)).alias("first_day"),
            F.make_date(F.lit(year), F.lit(12), F.lit(31)).alias("last_day"),
        )
    )


def contract_grid(
    hours: DataFrame, minutes: int = 15, start_hours: int = 4, zone: str | None = None
) -> DataFrame:
    """Bins of the last start_hours of every contract, on two clocks.

    bin_timestamp is the wall clock (no jump on clock-change days);
    bin_timestamp_real is the instant. Without a zone both are the same."""
    n = start_hours * 60 // minutes
    wall = at_hour(F.col("delivery_date"), F.col("delivery_hour"))
    start = (
        effective_start(F.col("delivery_date"), F.col("delivery_hour"), zone) if zone else wall
    )
    step = F.col("bin") * minutes - start_hours * 60
    return (
        hours.select(
            *CONTRACT,
            wall.alias("delivery_start_wall"),
            start.alias("delivery_start"),
            F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"),
        )
        .withColumn("bin_timestamp", shift_minutes(F.col("delivery_start_wall"), step))
        .withColumn("bin_timestamp_real", shift_minutes(F.col("delivery_start"), step))
    )


def bin_vwap(trades: DataFrame, minutes: int = 15, start_hours: int = 4) -> DataFrame:
    """VWAP and trade count per (contract start, bin) of the last start_hours.

    Reduced map-side: the shuffle carries one row per contract, bin and task."""
    width = minutes * 60_000_000
    since = micros(F.col("exec_ts")) - (
        micros(F.col("delivery_start")) - start_hours * 3_600_000_000
    )
    k = F.floor(since / width).cast("int")
    start, at = F.col("delivery_start"), F.col("exec_ts")
    return (
        trades.filter((at >= shift_minutes(start, -60 * start_hours)) & (at < start))
        .select("delivery_start", k.alias("bin"), "price", "qty_mw")
        .groupBy("delivery_start", "bin")
        .agg(vwap(F.col("price"), F.col("qty_mw")).alias("bin_vwap"), F.count(F.lit(1)).alias("n"))
    )


def bin_series(
    trades: DataFrame,
    da: DataFrame,
    hours: DataFrame,
    minutes: int = 15,
    start_hours: int = 4,
    zone: str | None = None,
    sentinel: float | None = None,
) -> DataFrame:
    """Price, price change and trade flag for every bin of every contract.

    A contract with no priced bin takes the day-ahead price throughout and counts
    as untraded; otherwise an empty first bin is seeded with it and later gaps
    carry the last price forward. Trades before the window play no part."""
    grid = contract_grid(hours, minutes, start_hours, zone)
    traded = bin_vwap(trades, minutes, start_hours)
    rows = grid.join(traded, ["delivery_start", "bin"], "left").join(
        da.select(*CONTRACT, F.col("price").alias("_da")), CONTRACT, "left"
    )
    whole = W.partitionBy(*CONTRACT)
    upto = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    fallback = F.col("_da") if sentinel is None else F.coalesce("_da", F.lit(sentinel))
    seeded = F.when(
        F.col("bin_vwap").isNull() & (F.col("bin") == 0), fallback
    ).otherwise(F.col("bin_vwap"))
    filled = rows.select(
        "*",
        (F.count("bin_vwap").over(whole) == 0).alias("_empty"),
        F.last(seeded, ignorenulls=True).over(upto).alias("vwap"),
    )
    prev = F.lag("vwap").over(whole.orderBy("bin"))
    return filled.select(
        *CONTRACT,
        "delivery_start_wall",
        "delivery_start",
        "bin",
        "bin_timestamp",
        "bin_timestamp_real",
        "vwap",
        F.coalesce(F.col("vwap") - prev, F.lit(0.0)).alias("vwap_changes"),
        F.when(F.col("n").isNotNull() & ~F.col("_empty"), 1).otherwise(0).alias("alpha"),
    )


def ffill(df: DataFrame, col: str, keys: list[str] = CONTRACT, order: str = "bin") -> DataFrame:
    """Last known value within a contract (a contract has a fixed number of bins)."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(col, F.last(col, ignorenulls=True).over(w))


def diff0(df: DataFrame, col: str, out: str, keys: list[str] = CONTRACT, order: str = "bin"):
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.coalesce(F.col(col) - F.lag(col).over(w), F.lit(0.0)))


def first_vwap(bins: DataFrame) -> DataFrame:
    priced = bins.filter(F.col("vwap").isNotNull())
    return priced.groupBy(*CONTRACT).agg(F.min_by("vwap", "bin").alias("first_vwap"))
