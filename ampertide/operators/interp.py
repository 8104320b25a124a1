"""Piecewise-linear interpolation of keyed curves at query points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import nearest_known


def interp(
    queries: DataFrame,
    curve: DataFrame,
    keys: list[str],
    x: str = "x",
    y: str = "y",
    outside: str = "clamp",
    cell_width: float | None = None,
    out: str = "y",
) -> DataFrame:
    """Value of the curve at each distinct (keys, x) of `queries`; null for keys
    without a curve.

    Sort, no theta join: knots and queries are merged along x and each query takes
    the knots on either side. Equal queries are answered once. Repeated knots
    collapse to the highest y. outside: 'clamp' (end values) or 'zero'. With a
    cell_width the x axis is cut in cells and one curve may span many tasks; leave
    it out only for curves of bounded size."""
    if outside not in ("clamp", "zero"):
        raise ValueError("outside is 'clamp' or 'zero'")
    knots = (
        curve.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).cast("double").alias("_x"))
        .agg(F.max(F.col(y).cast("double")).alias("_y"))
    )
    asked = queries.select(*keys, F.col(x).cast("double").alias("_x")).distinct()
    points = knots.select(*keys, "_x", F.struct("_x", "_y").alias("knot")).unionByName(
        asked.select(*keys, "_x", F.lit(None).cast("struct<_x:double,_y:double>").alias("knot"))
    )
    cell = None if cell_width is None else F.floor(F.col("_x") / cell_width)
    near = nearest_known(points.withColumn("_q", F.col("knot").isNull()), keys, "_x", "knot", cell)
    lo, hi = F.col("prev_knot"), F.col("next_knot")
    inside = F.when(
        hi["_x"] == lo["_x"], lo["_y"]
    ).otherwise(
        lo["_y"]
        + (F.col("_x") - lo["_x"])
        * (hi["_y"] - lo["_y"])
        / F.when(hi["_x"] != lo["_x"], hi["_x"] - lo["_x"])
    )
    beyond = F.coalesce(lo["_y"], hi["_y"])
    if outside == "zero":
        beyond = F.when(beyond.isNotNull(), F.lit(0.0))
    value = F.when(lo.isNotNull() & hi.isNotNull(), inside).otherwise(beyond)
    return near.filter("_q").select(*keys, F.col("_x").alias(x), value.alias(out))


def at_points(
    df: DataFrame, curve: DataFrame, keys: list[str], col: str, out: str, **kw
) -> DataFrame:
    """`df` with `out`, the curve value at df[col]; the x of the curve is `x`."""
    vals = interp(df.select(*keys, F.col(col).alias("x")), curve, keys, out=out, **kw)
    return df.join(vals.withColumnRenamed("x", col), [*keys, col], "left")
