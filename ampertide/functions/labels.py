"""Hour labels and wide hourly tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hour_of_label(label: Column) -> Column:
    """'Hour 7', '7', '3A' -> 6, 6, 2 (labels count from 1); 'xB' and anything
    outside 1..24 -> null."""
    digits = F.regexp_extract(label, r"(?i)^\s*(?:hour)?\s*(\d{1,2})\s*a?\s*$", 1)
    h = F.when(digits != "", digits).try_cast("int") - 1
    return F.when(h.between(0, 23), h)


def unpivot_hours(df: DataFrame, date_col: str, combine: str = "first") -> DataFrame:
    """Wide hourly prices -> (delivery_date, delivery_hour, price).

    The doubled autumn hour ('3A', '3B') gives its first value ('first') or the
    mean of those present ('mean')."""
    if combine not in ("first", "mean"):
        raise ValueError("combine is 'first' or 'mean'")
    hours = [c for c in df.columns if c != date_col]
    long = df.select(
        F.col(date_col).alias("delivery_date"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").cast("double").alias("price"))
                    for c in hours
                ]
            )
        ).alias("h"),
    ).select("delivery_date", "h.*")
    second = F.upper("label").rlike(r"\dB\s*$")
    as_first = F.regexp_replace("label", r"(?i)b\s*$", "")
    out = long.withColumn("second", second).withColumn(
        "delivery_hour", hour_of_label(F.when(second, as_first).otherwise(F.col("label")))
    ).filter(F.col("delivery_hour").isNotNull())
    value = (
        F.avg("price") if combine == "mean" else F.max(F.when(~F.col("second"), F.col("price")))
    )
    return out.groupBy("delivery_date", "delivery_hour").agg(value.alias("price"))


def interpolate_hours(
    df: DataFrame, col: str, day: str = "delivery_date", hour: str = "delivery_hour"
) -> DataFrame:
    """Fills missing hours of a day linearly, the ends with the nearest value.

    At most 24 rows per window."""
    w = W.partitionBy(day)
    past = (W.unboundedPreceding, W.currentRow)
    known = F.when(F.col(col).isNotNull(), F.struct(F.col(hour).alias("h"), F.col(col).alias("v")))
    lo = F.last(known, ignorenulls=True).over(w.orderBy(hour).rowsBetween(*past))
    hi = F.last(known, ignorenulls=True).over(w.orderBy(F.desc(hour)).rowsBetween(*past))
    d = df.select("*", lo.alias("_lo"), hi.alias("_hi"))
    gap = F.col("_hi.h") - F.col("_lo.h")
    between = F.col("_lo.v") + (F.col(hour) - F.col("_lo.h")) * (
        F.col("_hi.v") - F.col("_lo.v")
    ) / F.when(gap > 0, gap)
    return d.withColumn(
        col, F.coalesce(F.col(col), between, F.col("_lo.v"), F.col("_hi.v"))
    ).drop("_lo", "_hi")


def complete_day_hours(df: DataFrame, day: str = "delivery_date", hour: str = "delivery_hour"):
    """All 24 hours of every day in `df`, null where absent."""
    axis = df.select(day).distinct().select(
        day, F.explode(F.sequence(F.lit(0), F.lit(23))).alias(hour)
    )
    return axis.join(df, [day, hour], "left")
