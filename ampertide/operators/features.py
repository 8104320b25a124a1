"""Feature derivation on the bin grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import minutes_between, shift_hour, weekday_flags
from ..functions.numeric import clean_number
from .bins import CONTRACT
from .ordered import trailing

STANDARD_LAGS = {
    "vwap": [1, 2, 3],
    "vwap_changes": [1, 2, 3],
    "alpha": list(range(1, 13)),
    "abs_vwap_changes": list(range(1, 13)),
}


def with_slopes(bins: DataFrame, slopes: DataFrame) -> DataFrame:
    return bins.join(slopes, [*CONTRACT, "bin"], "left")


def with_res(bins: DataFrame, res: DataFrame) -> DataFrame:
    # No hint: the forecasts are broadcast only when their measured size allows.
    return bins.join(res, CONTRACT, "left")


def with_da_price(bins: DataFrame, da: DataFrame, spring_days: DataFrame | None = None) -> DataFrame:
    """Day-ahead price per row, null if absent. On the days of
    `spring_days(delivery_date)` the skipped hour 2 takes the price of hour 3."""
    price = da.select(*CONTRACT, F.col("price").alias("da_price"))
    if spring_days is not None:
        lent = (
            price.filter(F.col("delivery_hour") == 3)
            .join(spring_days.select("delivery_date"), "delivery_date", "left_semi")
            .select("delivery_date", F.lit(2).alias("delivery_hour"), "da_price")
        )
        own = price.join(lent.select(*CONTRACT), CONTRACT, "left_anti")
        price = own.unionByName(lent)
    return bins.join(price, CONTRACT, "left")


def outer_suffix_join(
    a: DataFrame, b: DataFrame, on: list[str], sa: str, sb: str
) -> DataFrame:
    """Full outer join; columns in both sides get the side's suffix."""
    both = (set(a.columns) & set(b.columns)) - set(on)
    left = a.select(*[F.col(c).alias(c + sa) if c in both else F.col(c) for c in a.columns])
    right = b.select(*[F.col(c).alias(c + sb) if c in both else F.col(c) for c in b.columns])
    return left.join(right, on, "full_outer")


def with_calendar(bins: DataFrame, day: str = "delivery_date") -> DataFrame:
    return bins.withColumns(weekday_flags(F.col(day)))


def with_ttd(bins: DataFrame, minutes: int = 15) -> DataFrame:
    """Bins to delivery and their decay 1/sqrt(1+TTD)."""
    ttd = minutes_between(F.col("delivery_start_wall"), F.col("bin_timestamp")) / minutes
    return bins.withColumn("TTD_bins", ttd).withColumn(
        "f_TTD", 1.0 / F.sqrt(1.0 + F.col("TTD_bins"))
    )


def ttd_one_hot(df: DataFrame, n: int, col: str = "TTD_bins") -> DataFrame:
    level = F.floor(F.col(col))
    return df.withColumns({f"TTD_bin_{k}": (level == k).cast("int") for k in range(1, n + 1)})


def ttd_from_one_hot(df: DataFrame, n: int) -> DataFrame:
    """Index of the set TTD_bin column; null if none is set."""
    flags = F.array(*[F.col(f"TTD_bin_{k}") for k in range(1, n + 1)])
    at = F.array_position(flags, F.lit(1)).cast("int")
    return df.withColumn("ttd_idx", F.when(at > 0, at))


def last_hours(df: DataFrame, hours: int = 4, minutes: int = 15, col: str = "TTD_bins") -> DataFrame:
    return df.filter(F.col(col) <= hours * 60 // minutes)


def _next_to_source(df: DataFrame, extra: dict[str, list[tuple[str, Column]]]) -> DataFrame:
    cols: list[Column] = []
    new = {name for added in extra.values() for name, _ in added}
    for c in df.columns:
        if c in new:
            continue
        cols.append(F.col(c))
        cols.extend(expr.alias(name) for name, expr in extra.get(c, []))
    return df.select(*cols)


def add_abs(df: DataFrame, cols: list[str]) -> DataFrame:
    return _next_to_source(df, {c: [(f"abs_{c}", F.abs(c))] for c in cols if c in df.columns})


def add_lags(
    df: DataFrame,
    lags: dict[str, list[int]],
    keys: list[str] = CONTRACT,
    order: str = "bin",
) -> DataFrame:
    """Lags within a contract, placed after their source; all share one sort."""
    w = W.partitionBy(*keys).orderBy(order)
    return _next_to_source(
        df,
        {
            c: [(f"{c}_lag{k}", F.lag(c, k).over(w)) for k in ks]
            for c, ks in lags.items()
            if c in df.columns
        },
    )


def response_lags(
    df: DataFrame, col: str, max_lag: int, order: list[str], cell: Column, block: int = 4096
) -> DataFrame:
    """Lags of one long series without a key; the first max_lag rows are dropped.

    Runs in blocks of the row index with a halo, not in one task."""
    columns = {
        f"{col}_lag{k}": (lambda w, k=k: F.lag(col, k).over(w)) for k in range(1, max_lag + 1)
    }
    out = trailing(df, [], order, max_lag, cell, columns, block)
    return out.filter(F.col("_idx") >= max_lag).drop("_idx")


def lag_sum(df: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    """Sum of col_lag<lo> .. col_lag<hi>."""
    total = reduce(lambda a, b: a + b, [F.col(f"{col}_lag{k}") for k in range(lo, hi + 1)])
    return df.withColumn(f"{col}_lag{lo}_{hi}", total)


def add_spread(df: DataFrame, absolute: bool = False) -> DataFrame:
    """Day-ahead minus intraday: signed with the current and lagged price, or the
    absolute gap to the last price."""
    da = F.col("da_price")
    if absolute:
        return df.withColumn("da-id", F.abs(da - F.col("vwap_lag1")))
    return df.withColumns(
        {
            "da-id": da - F.col("vwap"),
            "da-id_lag1": da - F.col("vwap_lag1"),
            "da-id_lag2": da - F.col("vwap_lag2"),
        }
    )


def design_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exactly `cols` as finite doubles; columns that do not exist are 0."""
    have = set(df.columns)
    return df.withColumns(
        {c: clean_number(F.col(c)) if c in have else F.lit(0.0) for c in cols}
    )


def contract_pairs(contracts: DataFrame, value_cols: list[str]) -> DataFrame:
    """Each contract beside the next one in delivery order.

    `contracts` has one row per delivery_start. The next start is found per day,
    with the first start of the following traded day for the last of a day."""
    days = contracts.groupBy(F.to_date("delivery_start").alias("_day")).agg(
        F.min("delivery_start").alias("_first")
    )
    # One row per day: the calendar bounds this window, not the data volume.
    following = days.select(
        "_day", F.lead("_first").over(W.orderBy("_day")).alias("_next_day_first")
    )
    w = W.partitionBy("_day").orderBy("delivery_start")
    linked = (
        contracts.withColumn("_day", F.to_date("delivery_start"))
        .join(following, "_day")
        .withColumn("next_start", F.coalesce(F.lead("delivery_start").over(w), "_next_day_first"))
        .drop("_day", "_next_day_first")
    )
    nxt = contracts.select(
        F.col("delivery_start").alias("next_start"),
        *[F.col(c).alias(f"next_{c}") for c in value_cols],
    )
    return linked.filter(F.col("next_start").isNotNull()).join(nxt, "next_start")


def delta_lookup(df: DataFrame) -> DataFrame:
    """Mean price change per (day, hour, time to delivery)."""
    return df.groupBy("delivery_date", "delivery_hour", "ttd").agg(
        F.avg("vwap_changes").alias("delta")
    )


def neighbor_features(
    df: DataFrame,
    offsets: tuple[int, ...] = (-2, -1, 1, 2),
    ttd_max: int = 16,
    slots_per_hour: int = 4,
) -> DataFrame:
    """Last available price change of neighbouring contracts before each row.

    For hour offset o the neighbour stands at n = ttd + o*slots_per_hour: the
    change at n, else at the nearest larger ttd up to ttd_max; a closed neighbour
    (n < 1) gives its change at ttd 1; none or not yet open gives 0. `df` has
    delivery_date, delivery_hour, ttd and vwap_changes.

    One lookup row per neighbour contract carries its few changes as an array
    (at most ttd_max entries), so the join never multiplies rows."""
    path = (
        delta_lookup(df.filter(F.col("ttd").between(1, ttd_max)))
        .groupBy("delivery_date", "delivery_hour")
        .agg(F.array_sort(F.collect_list(F.struct("ttd", "delta"))).alias("path"))
    )
    base = df.filter(F.col("ttd") <= ttd_max)
    names = {o: f"nb_dchg_{'m' if o < 0 else 'p'}{abs(o)}" for o in offsets}
    asks = F.array(
        *[
            F.struct(
                F.lit(names[o]).alias("name"),
                *[
                    c.alias(a)
                    for c, a in zip(
                        shift_hour(F.col("delivery_date"), F.col("delivery_hour"), o),
                        ("nb_date", "nb_hour"),
                    )
                ],
                (F.col("ttd") + o * slots_per_hour).alias("n"),
            )
            for o in offsets
        ]
    )
    wanted = (
        base.select("delivery_date", "delivery_hour", "ttd").distinct()
        .select("*", F.explode(asks).alias("a"))
        .select("delivery_date", "delivery_hour", "ttd", "a.*")
    )
    found = wanted.join(
        path.select(
            F.col("delivery_date").alias("nb_date"), F.col("delivery_hour").alias("nb_hour"), "path"
        ),
        ["nb_date", "nb_hour"],
        "left",
    )
    n = F.col("n")
    usable = F.filter(
        "path", lambda e: F.when(n < 1, e["ttd"] == 1).otherwise((n <= ttd_max) & (e["ttd"] >= n))
    )
    value = F.coalesce(F.try_element_at(usable, F.lit(1))["delta"], F.lit(0.0))
    wide = (
        found.withColumn("v", value)
        .groupBy("delivery_date", "delivery_hour", "ttd")
        .pivot("name", [names[o] for o in offsets])
        .agg(F.first("v"))
    )
    return base.join(wide, ["delivery_date", "delivery_hour", "ttd"])
