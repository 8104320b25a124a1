"""Merit-order operators on supply and demand curves.

Curves are rows (curve_date, curve_hour, side, price, volume), volume cumulative.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .interp import at_points, interp

CURVE = ["curve_date", "curve_hour"]
PRICE_FLOOR = -500.0
PRICE_CELL = 100.0


def supply(curves: DataFrame) -> DataFrame:
    s = curves.filter(F.lower("side") == "sell")
    return s.select(*CURVE, F.col("price").alias("x"), F.col("volume").alias("y"))


def demand(curves: DataFrame) -> DataFrame:
    s = curves.filter(F.lower("side").isin("buy", "purchase"))
    return s.select(*CURVE, F.col("price").alias("x"), F.col("volume").alias("y"))


def curve_bounds(curves: DataFrame) -> DataFrame:
    """Price range and number of points of each side of each curve."""
    kind = F.when(F.lower("side") == "sell", "supply").when(
        F.lower("side").isin("buy", "purchase"), "demand"
    )
    return (
        curves.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .groupBy(*CURVE, "kind")
        .agg(
            F.min("price").alias("price_min"),
            F.max("price").alias("price_max"),
            F.count(F.lit(1)).alias("n_points"),
        )
    )


def inelastic_demand(curves: DataFrame, p_min: float = PRICE_FLOOR) -> DataFrame:
    """Demand at the price floor; 0 when the floor is outside the curve."""
    d = demand(curves)
    asked = d.select(*CURVE).distinct().withColumn("x", F.lit(p_min))
    return interp(asked, d, CURVE, outside="zero", cell_width=PRICE_CELL, out="inelastic_demand")


def transformed_supply(
    curves: DataFrame, n: int = 500, p_min: float = PRICE_FLOOR
) -> DataFrame:
    """S(p) + D(p_min) - D(p) on n prices across the supply range of each curve."""
    kind = F.when(F.lower("side") == "sell", "s").otherwise("d")
    known = curves.filter(F.lower("side").isin("sell", "buy", "purchase"))
    knots = known.select(*CURVE, kind.alias("kind"), F.col("price").alias("x"), F.col("volume").alias("y"))
    span = supply(curves).groupBy(*CURVE).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    point = F.when(F.col("i") == n - 1, F.col("hi")).otherwise(F.col("lo") + F.col("i") * step)
    # Index -1 is the price floor; every point asks both sides in one pass.
    grid = span.select("*", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))).alias("i")).select(
        *CURVE, "i", F.when(F.col("i") < 0, F.lit(p_min)).otherwise(point).alias("x")
    )
    asked = grid.select("*", F.explode(F.array(F.lit("s"), F.lit("d"))).alias("kind"))
    vals = at_points(asked, knots, [*CURVE, "kind"], "x", "y", outside="zero", cell_width=PRICE_CELL)
    sides = vals.groupBy(*CURVE, "i").agg(
        F.first("x").alias("price"),
        F.coalesce(F.max(F.when(F.col("kind") == "s", F.col("y"))), F.lit(0.0)).alias("s"),
        F.coalesce(F.max(F.when(F.col("kind") == "d", F.col("y"))), F.lit(0.0)).alias("d"),
    )
    # n + 1 rows per curve.
    floor = F.max(F.when(F.col("i") < 0, F.col("d"))).over(W.partitionBy(*CURVE))
    return (
        sides.select(*CURVE, "i", "price", (F.col("s") + floor - F.col("d")).alias("volume"))
        .filter(F.col("i") >= 0)
    )


def merit_order_slope(
    ts: DataFrame, prices: DataFrame, qs: tuple[int, ...] = (500, 1000, 2000)
) -> DataFrame:
    """Slope of the merit order around each distinct (curve, price) of `prices`:
    (P(v+q) - P(max(v-q, 0))) / 2q with v the volume at that price.

    `ts` is the fixed grid of transformed_supply and the prices are distinct per
    contract, so every key is small here. `ts` is read twice: write or checkpoint
    it first when it is large."""
    by_price = ts.select(*CURVE, F.col("price").alias("x"), F.col("volume").alias("y"))
    by_volume = ts.select(*CURVE, F.col("volume").alias("x"), F.col("price").alias("y"))
    asked = prices.select(*CURVE, "price").filter(F.col("price").isNotNull()).distinct()
    implied = at_points(asked, by_price, CURVE, "price", "v")
    steps = F.array(*[F.lit(float(q)) for q in qs])
    ends = (
        implied.filter(F.col("v").isNotNull())
        .select("*", F.explode(steps).alias("q"))
        .select("*", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("sgn"))
        .withColumn(
            "pv",
            F.when(F.col("sgn") > 0, F.col("v") + F.col("q")).otherwise(
                F.greatest(F.col("v") - F.col("q"), F.lit(0.0))
            ),
        )
    )
    priced = at_points(ends, by_volume, CURVE, "pv", "p")
    return priced.groupBy(*CURVE, "price").agg(
        *[
            (F.sum(F.when(F.col("q") == float(q), F.col("sgn") * F.col("p"))) / (2.0 * q)).alias(
                f"mo_slope_{q}"
            )
            for q in qs
        ]
    )


def slopes_for_bins(
    bins: DataFrame, ts: DataFrame, spring_days: DataFrame | None = None, **kw
) -> DataFrame:
    """Merit-order slopes of every bin at its carried-forward price.

    Each distinct (curve, price) is solved once and joined back. On the days of
    `spring_days(curve_date)` a missing hour 2 borrows the curve of hour 3."""
    if spring_days is not None:
        has2 = ts.filter(F.col("curve_hour") == 2).select("curve_date").distinct()
        lent = (
            ts.filter(F.col("curve_hour") == 3)
            .join(spring_days.select("curve_date"), "curve_date", "left_semi")
            .join(has2, "curve_date", "left_anti")
            .withColumn("curve_hour", F.lit(2))
        )
        ts = ts.unionByName(lent)
    key = bins.select(
        F.col("delivery_date").alias("curve_date"),
        F.col("delivery_hour").alias("curve_hour"),
        F.col("vwap").alias("price"),
    )
    slopes = (
        merit_order_slope(ts, key, **kw)
        .withColumnRenamed("curve_date", "delivery_date")
        .withColumnRenamed("curve_hour", "delivery_hour")
        .withColumnRenamed("price", "vwap")
    )
    return bins.join(slopes, ["delivery_date", "delivery_hour", "vwap"], "left")


def elasticity_at(
    ts: DataFrame, qs: tuple[int, ...] = (500, 1000, 2000)
) -> DataFrame:
    """(P(P(q)+q) - P(P(q)-q)) / 2q with P the clamped volume-to-price curve.

    The inner P(q) is a price used as a volume; kept as defined. The slope of
    merit_order_slope is the metric to prefer."""
    by_volume = ts.select(*CURVE, F.col("volume").alias("x"), F.col("price").alias("y"))
    steps = F.array(*[F.lit(float(q)) for q in qs])
    asked = by_volume.select(*CURVE).distinct().select("*", F.explode(steps).alias("q"))
    inner = at_points(asked, by_volume, CURVE, "q", "v")
    ends = inner.select(
        *CURVE, "q", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("sgn"), "v"
    ).withColumn("pv", F.col("v") + F.col("sgn") * F.col("q"))
    priced = at_points(ends, by_volume, CURVE, "pv", "p")
    return (
        priced.groupBy(*CURVE, "q")
        .agg((F.sum(F.col("sgn") * F.col("p")) / (2.0 * F.col("q"))).alias("elasticity"))
        .select(*CURVE, F.col("q").cast("int").alias("q"), "elasticity")
    )


def combine(*frames: DataFrame) -> DataFrame:
    """Union of files, years or chunks whose columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
