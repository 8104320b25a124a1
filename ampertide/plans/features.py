"""Feature table of the bin grid: tape to model-ready rows, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import is_spring_change, to_local
from ..operators import bins as B
from ..operators import curves as K
from ..operators import features as X
from ..operators import tape as T
from ..session import cut


@dataclass
class FeatureConfig:
    year: int | None = None
    product: str = "hourly"
    minutes: int = 15
    start_hours: int = 4
    zone: str | None = "Europe/Amsterdam"
    dropped_hours: tuple[int, ...] = ()
    curve_points: int = 500
    price_floor: float = -500.0
    sentinel: float | None = None


def product_trades(trades: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Trades of the product, year and hours; the year is a range that reaches the scan."""
    if cfg.year is not None:
        trades = T.of_year(trades, cfg.year, zone=cfg.zone)
    d = T.of_product(T.with_duration(T.clean_tape(trades)), cfg.product)
    return T.drop_hours(d, list(cfg.dropped_hours), zone=cfg.zone) if cfg.dropped_hours else d


def clean_trades(trades: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Continuous trades of one product, one row per trade id, needed columns only.

    Pruned before the dedupe shuffle, the only one that moves single trades."""
    d = product_trades(trades, cfg).select("trade_id", "exec_ts", "delivery_start", "price", "qty_mw")
    return T.dedupe(d, ["trade_id"], [F.col("exec_ts"), F.col("price"), F.col("qty_mw")])


def price_grid(spark, trades: DataFrame, da: DataFrame, cfg: FeatureConfig) -> DataFrame:
    clean = clean_trades(trades, cfg)
    if cfg.year is not None:
        hours = B.year_calendar(spark, cfg.year)
    else:
        # Bounds need no dedupe, and so no shuffle of trades.
        start = to_local(F.col("delivery_start"), cfg.zone) if cfg.zone else F.col("delivery_start")
        hours = B.calendar(
            product_trades(trades, cfg).agg(F.to_date(F.min(start)).alias("first_day"), F.to_date(F.max(start)).alias("last_day"))
        )
    if cfg.dropped_hours:
        hours = hours.filter(~F.col("delivery_hour").isin(list(cfg.dropped_hours)))
    return B.bin_series(clean, da, hours, cfg.minutes, cfg.start_hours, cfg.zone, cfg.sentinel)


def prepare_features(
    spark,
    trades: DataFrame,
    da: DataFrame,
    curves: DataFrame | None = None,
    res: DataFrame | None = None,
    cfg: FeatureConfig | None = None,
) -> DataFrame:
    """Grid, calendar, day-ahead price, merit-order slopes, forecasts, lags and
    spreads: the columns every model job reads."""
    cfg = cfg or FeatureConfig()
    grid = cut(price_grid(spark, trades, da, cfg))
    d = X.with_calendar(X.with_ttd(grid, cfg.minutes))
    spring = None
    if cfg.zone:
        spring = grid.select("delivery_date").distinct().filter(
            is_spring_change(F.col("delivery_date"), cfg.zone)
        )
    d = X.with_da_price(d, da, spring)
    if curves is not None:
        ts = cut(K.transformed_supply(curves, cfg.curve_points, cfg.price_floor))
        spring_curves = (
            None if spring is None else spring.withColumnRenamed("delivery_date", "curve_date")
        )
        slopes = K.slopes_for_bins(
            grid.select("delivery_date", "delivery_hour", "bin", "vwap"), ts, spring_curves
        ).drop("vwap")
        d = X.with_slopes(d, slopes)
    if res is not None:
        d = X.with_res(d, res)
    d = X.add_lags(X.add_abs(d, ["vwap_changes"]), X.STANDARD_LAGS)
    d = X.add_spread(d)
    n = cfg.start_hours * 60 // cfg.minutes
    d = X.last_hours(d, cfg.start_hours, cfg.minutes)
    return X.ttd_one_hot(d, n)
