"""Moments, Gram matrices, correlation, histograms, rolling moments."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .ordered import join_null_safe, running_total


def gram(
    df: DataFrame, xs: list[str], y: str | None = None, w: str | None = None, by: list[str] = ()
) -> DataFrame:
    """Weighted X'X (upper triangle) and X'y per key, one aggregate pass.

    Columns n, sum_w, g_<i>_<j>, xy_<i>, yy. Partial sums are formed map-side, so
    the shuffle carries one row per key and task whatever the key sizes are."""
    weight = F.col(w) if w else F.lit(1.0)
    x = [F.col(c).cast("double") for c in xs]
    aggs: list[Column] = [F.count(F.lit(1)).alias("n"), F.sum(weight).alias("sum_w")]
    for i, j in combinations_with_replacement(range(len(xs)), 2):
        aggs.append(F.sum(weight * x[i] * x[j]).alias(f"g_{i}_{j}"))
    if y:
        t = F.col(y).cast("double")
        aggs += [F.sum(weight * x[i] * t).alias(f"xy_{i}") for i in range(len(xs))]
        aggs.append(F.sum(weight * t * t).alias("yy"))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def scaler_fit(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """mean_<c> and var_<c> (population)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.var_pop(c).alias(f"var_{c}")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def scale(df: DataFrame, moments: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """z-scores; `moments` has one row per key (one row in all without keys)."""
    m = moments.drop("n")
    if by:
        joined = df.join(m, list(by), "left")
    else:
        # One row of moments: read as scalars, no join.
        joined = df.withColumns({c: m.select(c).scalar() for c in m.columns})
    return joined.select(
        *[
            ((F.col(c) - F.col(f"mean_{c}")) / F.sqrt(f"var_{c}")).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )


def covariance(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Sample covariance (ddof 1), upper triangle cov_<i>_<j>."""
    aggs = [
        F.covar_samp(cols[i], cols[j]).alias(f"cov_{i}_{j}")
        for i, j in combinations_with_replacement(range(len(cols)), 2)
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def truncation_box(
    df: DataFrame, cols: list[str], width: float = 10.0, fourth: bool = True
) -> DataFrame:
    """lo_<c>, hi_<c>: mean -+ width * sqrt(k2 + sqrt(k4)), or -+ width * sd."""
    out = []
    for c in cols:
        k2 = F.var_pop(c)
        k4 = F.coalesce(F.greatest(F.nanvl(F.kurtosis(c), F.lit(0.0)) * k2 * k2, F.lit(0.0)), F.lit(0.0))
        half = width * (F.sqrt(k2 + F.sqrt(k4)) if fourth else F.sqrt(k2))
        out += [(F.avg(c) - half).alias(f"lo_{c}"), (F.avg(c) + half).alias(f"hi_{c}")]
    return df.agg(*out)


def trim(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.filter(F.col(col).between(lo, hi))


def rolling_moments(
    df: DataFrame, cols: list[str], lookback: int, by: list[str], day: str = "delivery_date"
) -> DataFrame:
    """Mean and sample covariance over the previous `lookback` days per key and day, from the rows that
    have all of `cols`.

    Rows collapse to daily (n, means, co-moments) first; what follows has one row per calendar day. The calendar
    is cut into blocks of `lookback` days, so that a frame is the end of one block and the beginning of
    the next: both are growing sums within a block, about the block's own mean, and one merge
    gives the frame. The work is linear in days whatever the lookback, and nothing is subtracted
    from a running total."""
    by = list(by)
    k = range(len(cols))
    pairs = list(combinations_with_replacement(k, 2))
    have = F.lit(True)
    for c in cols:
        have = have & F.col(c).isNotNull()
    x = [F.when(have, F.col(c).cast("double")) for c in cols]
    zero = F.lit(0.0)
    daily = cut(
        df.groupBy(*by, day).agg(
            F.count(F.when(have, 1)).alias("_n"), *[F.coalesce(F.avg(x[i]), zero).alias(f"_m{i}") for i in k],
            *[F.coalesce(F.covar_pop(x[i], x[j]) * F.count(x[i]), zero).alias(f"_q{i}_{j}") for i, j in pairs],
        ).withColumn("_d", F.unix_date(day))
    )
    span = daily.groupBy(*by).agg((F.min("_d") - lookback).alias("lo"), F.max("_d").alias("hi"))
    grid = span.select(*by, F.explode(F.sequence("lo", "hi")).alias("_d"))
    grid = join_null_safe(grid, daily, [*by, "_d"], "left").withColumn("_b", F.floor(F.col("_d") / lookback))
    block = W.partitionBy(*by, "_b")
    n = F.coalesce("_n", F.lit(0))
    grid = grid.withColumns({"_n": n, **{f"_c{i}": F.coalesce(F.sum(n * F.col(f"_m{i}")).over(block) / F.sum(n).over(block), zero) for i in k}})
    off = [F.coalesce(F.col(f"_m{i}") - F.col(f"_c{i}"), zero) for i in k]
    terms = {"n": F.col("_n"), **{f"s{i}": F.col("_n") * off[i] for i in k}}
    terms |= {f"p{i}_{j}": F.coalesce(f"_q{i}_{j}", zero) + F.col("_n") * off[i] * off[j] for i, j in pairs}
    centres = [F.col(f"_c{i}").alias(f"c{i}") for i in k]

    def sums(order):
        w = block.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return F.struct(*[F.sum(t).over(w).alias(name) for name, t in terms.items()], *centres)

    grid = grid.select(*by, day, "_d", sums(F.col("_d")).alias("_head"), sums(F.desc("_d")).alias("_tail"))
    along = W.partitionBy(*by).orderBy("_d")
    # A frame that starts with a block is that block's own beginning alone.
    tail = F.when(F.pmod("_d", F.lit(lookback)) != 0, F.lag("_tail", lookback).over(along))
    out = grid.withColumns({"_a": tail, "_z": F.lag("_head", 1).over(along)}).filter(F.col(day).isNotNull())
    n1, n2 = F.coalesce("_a.n", F.lit(0)), F.coalesce("_z.n", F.lit(0))
    total = n1 + n2

    def mean(side, m, i):
        return F.when(m > 0, F.col(f"{side}.c{i}") + F.col(f"{side}.s{i}") / m)

    def spread_(side, m, i, j):
        return F.when(m > 0, F.col(f"{side}.p{i}_{j}") - F.col(f"{side}.s{i}") * F.col(f"{side}.s{j}") / m)

    out = out.withColumns(
        {"n": total, **{f"_x{i}": mean("_a", n1, i) for i in k}, **{f"_y{i}": mean("_z", n2, i) for i in k}}
    )
    gap = [F.coalesce(F.col(f"_y{i}") - F.col(f"_x{i}"), zero) for i in k]
    share = F.try_divide(n2, total)
    return out.select(
        *by, day, "n", *[F.coalesce(F.col(f"_x{i}") + gap[i] * share, f"_y{i}").alias(f"mean_{i}") for i in k],
        *[
            F.when(
                total > 1,
                (F.coalesce(spread_("_a", n1, i, j), zero) + F.coalesce(spread_("_z", n2, i, j), zero) + gap[i] * gap[j] * n1 * share)
                / (total - 1),
            ).alias(f"cov_{i}_{j}")
            for i, j in pairs
        ],
    )


def delta_histogram(
    df: DataFrame,
    col: str = "vwap_changes",
    flag: str = "alpha",
    bins: int = 101,
    xlim: tuple[float, float] | None = None,
) -> DataFrame:
    """Counts per bin, symmetric about zero with an odd number of bins, or over a
    fixed range; with the count where the flag is 0. The last edge is closed.
    Bins without rows are listed with 0."""
    d = df.select(F.col(col).cast("double").alias("x"), flag).na.drop()
    if xlim is None:
        bins += 1 - bins % 2
        span = d.agg(F.max(F.abs("x")).alias("hi")).select((-F.col("hi")).alias("lo"), "hi")
    else:
        d = d.filter(F.col("x").between(*xlim))
        span = d.sparkSession.range(1).select(
            F.lit(float(xlim[0])).alias("lo"), F.lit(float(xlim[1])).alias("hi")
        )
    # The span is one row, read as two scalars.
    at = d.withColumns({c: span.select(c).scalar() for c in ("lo", "hi")})
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = at.groupBy(slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag) == 0).alias("n_alpha0")
    )
    axis = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("slot"))
    left = F.col("lo") + F.col("slot") * width
    return axis.join(counts, "slot", "left").select(
        "slot",
        left.alias("left_edge"),
        (left + width / 2).alias("center"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_alpha0", F.lit(0)).alias("n_alpha0"),
        ((left <= 0) & (left + width > 0)).alias("is_zero_bin"),
    )


def pairwise_correlation(
    df: DataFrame, keys: list[str], axis: str, value: str, levels: list[int]
) -> DataFrame:
    """Correlation of `value` between every two levels of `axis`, aligned by keys.

    Rows become one vector per key; each task turns its vectors into partial cross
    products by one matrix product per batch, and Spark adds those up. No pair of
    rows is ever emitted. Values are centred by the mean of their level first (one number per
    level): correlations do not change, and large levels do not cancel the digits."""
    means = df.groupBy(axis).agg(F.avg(F.col(value).cast("double")).alias("_m")).filter(F.col(axis).isin(levels))
    table = means.agg(F.map_from_entries(F.collect_list(F.struct(F.col(axis).cast("string"), "_m"))).alias("t"))
    df = df.withColumn("_t", table.scalar())
    df = df.withColumn(value, F.col(value).cast("double") - F.get(F.array(F.element_at("_t", F.col(axis).cast("string"))), F.lit(0))).drop("_t")
    wide = df.groupBy(*keys).pivot(axis, levels).agg(F.avg(value))
    names = [f"v{i}" for i in range(len(levels))]
    vec = wide.select(*[F.col(f"`{lv}`").cast("double").alias(n) for lv, n in zip(levels, names)])
    lv = np.array(levels)

    def partial(batches):
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            ok = ~np.isnan(x)
            m, z = ok.astype(float), np.where(ok, x, 0.0)
            i, j = np.indices((len(lv), len(lv))).reshape(2, -1)
            yield pd.DataFrame(
                {
                    "a": lv[i], "b": lv[j],
                    "n": (m.T @ m).ravel(),
                    "sa": (z.T @ m).ravel(), "sb": (m.T @ z).ravel(),
                    "saa": ((z * z).T @ m).ravel(), "sbb": (m.T @ (z * z)).ravel(),
                    "sab": (z.T @ z).ravel(),
                }
            )

    parts = vec.mapInPandas(
        partial, "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"
    )
    total = parts.groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]
    )
    n = F.col("n")
    va = n * F.col("saa") - F.col("sa") ** 2
    vb = n * F.col("sbb") - F.col("sb") ** 2
    cov = n * F.col("sab") - F.col("sa") * F.col("sb")
    return total.select(
        "a", "b", n.cast("long").alias("n"),
        F.when((n > 1) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("corr"),
    )


def hour_correlation(bins: DataFrame) -> DataFrame:
    """24 x 24 correlation of price changes between delivery hours, aligned by day
    and bin, without the first of January."""
    day = F.col("delivery_date")
    d = bins.filter(~((F.month(day) == 1) & (F.dayofmonth(day) == 1)))
    return pairwise_correlation(
        d, ["delivery_date", "bin"], "delivery_hour", "vwap_changes", list(range(24))
    ).select(F.col("a").alias("h1"), F.col("b").alias("h2"), "n", "corr")


def describe_scores(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max; one row per column.

    The quartiles are exact order statistics with linear interpolation, from counts
    cumulated over cells of the value axis: no task holds a whole column."""
    stacked = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])
        ).alias("s")
    ).select("s.*").filter(F.col("v").isNotNull())
    moments = stacked.groupBy("metric").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    ties = stacked.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("m"))
    # asinh keeps the order and spaces cells evenly over all magnitudes.
    cum = running_total(ties, ["metric"], ["v"], ["m"], F.floor(F.asinh("v") * 50))

    def quantile(q):
        at = (F.col("tot_m") - 1) * q
        lo = F.min(F.when(F.col("cum_m") > F.floor(at), F.col("v")))
        hi = F.min(F.when(F.col("cum_m") > F.ceil(at), F.col("v")))
        part = F.max(at - F.floor(at))
        return lo + (hi - lo) * part

    quartiles = cum.groupBy("metric").agg(
        *[quantile(q).alias(f"p{round(q * 100)}") for q in (0.25, 0.5, 0.75)]
    )
    return moments.join(quartiles, "metric").select(
        "metric", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def mardia_nu(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Mean fourth power of the Mahalanobis distance and the implied degrees of
    freedom (infinite for light tails) per key.

    Pass one: moments per key, inverted as p x p matrices. Pass two: the quadratic
    form of every row in plain expressions, averaged map-side."""
    p = len(cols)
    by = list(by)
    d = df
    mom = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in cols]).alias("mu"),
        F.array(
            *[F.coalesce(F.covar_samp(a, b), F.lit(0.0)) for a in cols for b in cols]
        ).alias("s"),
    )

    def invert(batches):
        for pdf in batches:
            s = np.stack([np.asarray(v, dtype=float) for v in pdf["s"]]) if len(pdf) else np.empty((0, p * p))
            inv = np.linalg.pinv(s.reshape(-1, p, p), hermitian=True)
            yield pdf.drop(columns="s").assign(sinv=list(inv.reshape(-1, p * p)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mom.schema if f.name != "s")
    # One row per key: as a written table its size is known to the join below.
    inv = cut(mom.mapInPandas(invert, fields + ", sinv array<double>"))
    rows = d.select(*by, *cols)
    if by:
        rows = join_null_safe(rows, inv.drop("n"), by)
    else:
        rows = rows.withColumns({c: inv.select(c).scalar() for c in ("mu", "sinv")})
    dev = [F.col(c) - F.col("mu")[i] for i, c in enumerate(cols)]
    quad = sum(
        (dev[i] * dev[j] * F.col("sinv")[i * p + j] for i in range(p) for j in range(p)),
        F.lit(0.0),
    )
    beta = rows.select(*by, quad.alias("d2")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("d2") * F.col("d2")).alias("beta")
    )
    k = F.col("beta") / (p * (p + 2))
    out = beta.withColumn(
        "nu", F.when(k <= 1 + 1e-9, F.lit(float("inf"))).otherwise((4 * k - 2) / (k - 1))
    )
    return out


def select_best(df: DataFrame, by: list[str], score: str, payload: list[str]) -> DataFrame:
    """Row with the smallest score per key (ties to the smaller payload)."""
    pick = F.min(F.struct(score, *payload)).alias("_b")
    best = df.groupBy(*by).agg(pick) if by else df.agg(pick)
    return best.select(*by, F.col(f"_b.{score}").alias(score), *[f"_b.{c}" for c in payload])
