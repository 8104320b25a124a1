"""Lagged panel of neighbouring products, and trailing training sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import at_hour, micros, shift_minutes
from .ordered import first_per, trailing


@dataclass(frozen=True)
class LagDesign:
    """Which deliveries and which lags of them a forecast sees.

    own: lags of the delivery itself, besides its present value. run: how many other deliveries. ahead: at
    most so many of these lie before it. steps: the lags of each of them."""

    own: int = 3
    run: int = 4
    ahead: int = 2
    steps: tuple[int, ...] = (1,)

    def __post_init__(self):
        if not self.steps or min(self.steps) < 1:
            raise ValueError("steps are whole numbers from 1")

    def columns(self, horizon: int) -> dict[int, list[int]]:
        """Delivery offset -> lags. The deliveries are one run around the own one; it begins with the first
        that still trades `horizon` hours before delivery, and what it lacks there it gains at the end."""
        first = -max(0, min(self.ahead, horizon - 1))
        last = max(0, self.run + first)
        return {o: sorted(set(self.steps)) if o else [*range(self.own + 1)] for o in range(first, last + 1)}


def lag_name(alias: str, offset: int, lag: int) -> str:
    where = "curr" if offset == 0 else f"{'next' if offset > 0 else 'prev'}{abs(offset)}"
    return f"{alias}_{where}_{'now' if lag == 0 else f'lag{lag}'}"


def feature_names(alias: str, design: dict[int, list[int]], others: tuple[str, ...] = ()) -> list[str]:
    """Target first, own lags, earlier products, later products, other features."""
    order = [0] + sorted([o for o in design if o < 0], reverse=True) + sorted(
        [o for o in design if o > 0]
    )
    names = [lag_name(alias, 0, 0)]
    for o in order:
        names += [lag_name(alias, o, k) for k in sorted(set(design.get(o, []))) if (o, k) != (0, 0)]
    return names + [f"{a}_lag1" for a in others]


def prefilter(df: DataFrame, cols: list[str], start: str, end: str, lookback: int, ts: str = "ts"):
    """Needed columns and rows in [start - lookback - 1, end + 1) days only; both
    reach the Parquet scan."""
    lo = F.expr(f"CAST(DATE'{start}' - {lookback + 1} AS TIMESTAMP_NTZ)")
    hi = F.expr(f"CAST(DATE'{end}' + 1 AS TIMESTAMP_NTZ)")
    return df.select(*cols).filter((F.col(ts) >= lo) & (F.col(ts) < hi))


def unique_panel(df: DataFrame, value: str, hour: str = "delivery_hour", ts: str = "ts") -> DataFrame:
    """One value per (ts, hour): the calendar then bounds every training group."""
    return df.groupBy(ts, hour).agg(F.avg(value).alias(value))


def lag_join(
    df: DataFrame,
    value: str,
    alias: str,
    design: dict[int, list[int]],
    lag_minutes: int = 15,
    how: str = "inner",
    hour: str = "delivery_hour",
    ts: str = "ts",
) -> DataFrame:
    """Adds the value of product hour+offset at ts - lag for every (offset, lag).

    All lags travel in one shuffle: each source row is addressed to the rows that
    need it, one aggregate per (ts, hour) turns them into columns, and one
    join adds them. how='inner' keeps rows with every lag."""
    wanted = [(o, k) for o, ks in sorted(design.items()) for k in sorted(set(ks)) if (o, k) != (0, 0)]
    if not wanted:
        return df
    addresses = F.array(
        *[
            F.struct(
                F.lit(lag_name(alias, o, k)).alias("name"),
                shift_minutes(F.col(ts), k * lag_minutes).alias("to_ts"),
                F.pmod(F.col(hour) - o, F.lit(24)).cast("int").alias("to_hour"),
            )
            for o, k in wanted
        ]
    )
    sent = df.select(F.explode(addresses).alias("a"), F.col(value).alias("v")).select("a.*", "v")
    names = [lag_name(alias, o, k) for o, k in wanted]
    cols = (
        sent.groupBy(F.col("to_ts").alias(ts), F.col("to_hour").alias(hour))
        .agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names])
    )
    out = df.join(cols, [ts, hour], "left")
    return out.na.drop(subset=names) if how == "inner" else out


def lag_panel(
    df: DataFrame,
    value: str,
    alias: str,
    design: dict[int, list[int]],
    mode: str = "time",
    lag_minutes: int = 15,
    hour: str = "delivery_hour",
    ts: str = "ts",
    cell: Column | None = None,
) -> DataFrame:
    """Lag columns for every row, kept when missing. mode 'time' shifts the clock;
    mode 'rows' shifts by rows of the product's own series."""
    if mode == "time":
        return lag_join(df, value, alias, design, lag_minutes, "left", hour, ts)
    if mode != "rows":
        raise ValueError("mode is 'time' or 'rows'")
    reach = max(max(ks) for ks in design.values())
    columns = {
        f"_r{k}": (lambda w, k=k: F.lag(value, k).over(w)) for k in range(1, reach + 1)
    }
    cell = F.to_date(ts) if cell is None else cell
    shifted = trailing(df.select(ts, hour, value), [hour], [ts], reach, cell, columns)
    wanted = [(o, k) for o, ks in sorted(design.items()) for k in sorted(set(ks)) if (o, k) != (0, 0)]
    targets = F.array(
        *[
            F.struct(
                F.lit(lag_name(alias, o, k)).alias("name"),
                F.pmod(F.col(hour) - o, F.lit(24)).cast("int").alias("to_hour"),
                (F.col(f"_r{k}") if k else F.col(value)).alias("v"),
            )
            for o, k in wanted
        ]
    )
    sent = shifted.select(F.col(ts), F.explode(targets).alias("a")).select(ts, "a.*")
    names = [lag_name(alias, o, k) for o, k in wanted]
    cols = sent.groupBy(ts, F.col("to_hour").alias(hour)).agg(
        *[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names]
    )
    return df.join(cols, [ts, hour], "left")


def with_delivery_day(df: DataFrame, days: DataFrame, ts: str = "ts", hour: str = "delivery_hour"):
    """Delivery day by (ts, hour); of several the earliest is kept."""
    return df.join(first_per(days, [ts, hour], [F.col("delivery_date")]), [ts, hour], "left")


def horizon_window(
    df: DataFrame,
    horizons: tuple[int, ...] = (4, 3, 2, 1),
    minutes: int = 60,
    day: str = "delivery_date",
    hour: str = "delivery_hour",
    ts: str = "ts",
) -> DataFrame:
    """Rows of each horizon wh: wh hours before delivery, for `minutes`.

    The horizons are exploded next to the row and filtered, one pass for all."""
    start = shift_minutes(at_hour(F.col(day), F.col(hour)), F.col("wh") * -60)
    since = micros(F.col(ts)) - micros(start)
    return df.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("wh")).filter(
        (since >= 0) & (since < minutes * 60_000_000)
    )


def mvt_features(
    df: DataFrame,
    value: str,
    alias: str,
    design: dict[int, list[int]],
    horizons: tuple[int, ...] = (4, 3, 2, 1),
    minutes: int = 60,
    lag_minutes: int = 15,
) -> DataFrame:
    """Lagged feature rows per (day, hour, horizon) for the whole history at once."""
    windowed = horizon_window(df, horizons, minutes)
    lagged = lag_join(
        df.select("ts", "delivery_hour", value), value, alias, design, lag_minutes
    )
    out = windowed.select("delivery_date", "delivery_hour", "wh", "ts").join(
        lagged, ["ts", "delivery_hour"]
    )
    names = feature_names(alias, design)
    out = out.withColumnRenamed(value, names[0])
    return out.select("delivery_date", "delivery_hour", "wh", "ts", *names).na.drop(subset=names)


def trailing_groups(
    df: DataFrame, lookback: int, block_days: int = 30, day: str = "delivery_date", extra_day: bool = False
) -> DataFrame:
    """Copies each row into the day blocks that may train on it.

    Block b holds target days [b*block_days, (b+1)*block_days) and needs the rows
    of the `lookback` days before them: a row lands in about 1 + lookback /
    block_days blocks instead of in `lookback` training sets."""
    reach = lookback + (1 if extra_day else 0)
    d = F.unix_date(day)
    return df.select(
        "*",
        F.explode(
            F.sequence(F.floor(d / block_days), F.floor((d + reach) / block_days))
        ).alias("block"),
    )
