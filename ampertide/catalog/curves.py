"""Curve queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves as K
from ..operators.interp import interp
from ..session import cut
from . import views as V
from .registry import query
from .views import VIEW_SQL


def linear(
    queries: str, knots: str, keys: list[str], outside: str = "clamp"
) -> str:
    """SQL for the interpolated value y at each (keys, x) of `queries`; `knots` has
    distinct (keys, x, y)."""
    on = " AND ".join(f"k.{c} = q.{c}" for c in keys)
    cols = ", ".join(f"q.{c}" for c in keys)
    mid = "CASE WHEN hx = lx THEN ly ELSE ly + (x - lx) * (hy - ly) / nullif(hx - lx, 0) END"
    beyond = "coalesce(ly, hy)" if outside == "clamp" else "CASE WHEN coalesce(ly, hy) IS NOT NULL THEN 0.0 END"
    names = ", ".join(keys)
    return f"""SELECT {names}, x, CASE WHEN lx IS NOT NULL AND hx IS NOT NULL THEN {mid} ELSE {beyond} END AS y
      FROM (SELECT {cols}, q.x,
        max(k.x) FILTER (k.x <= q.x) AS lx, arg_max(k.y, k.x) FILTER (k.x <= q.x) AS ly,
        min(k.x) FILTER (k.x >= q.x) AS hx, arg_min(k.y, k.x) FILTER (k.x >= q.x) AS hy
        FROM (SELECT DISTINCT {names}, x FROM {queries}) q LEFT JOIN {knots} k ON {on} GROUP BY ALL) b"""


CK = ["curve_date", "curve_hour"]
_ON = "{a}.curve_date = {b}.curve_date AND {a}.curve_hour = {b}.curve_hour"

VIEW_SQL.update({
    "k_supply": (("fx_curves",), """SELECT curve_date, curve_hour, price AS x, max(volume) AS y FROM fx_curves
        WHERE side = 'Sell' GROUP BY ALL"""),
    "k_demand": (("fx_curves",), """SELECT curve_date, curve_hour, price AS x, max(volume) AS y FROM fx_curves
        WHERE side = 'Purchase' GROUP BY ALL"""),
    "k_floor": (("k_demand",), linear(
        "(SELECT curve_date, curve_hour, -500.0::DOUBLE AS x FROM k_demand)", "k_demand", CK, "zero")),
    "k_grid": (("k_supply",), """SELECT curve_date, curve_hour, CAST(i AS INT) AS i,
        CASE WHEN i = 499 THEN hi ELSE lo + i * ((hi - lo) / 499) END AS x FROM
        (SELECT curve_date, curve_hour, min(x) AS lo, max(x) AS hi FROM k_supply GROUP BY 1, 2) s,
        (SELECT unnest(range(500)) AS i) t"""),
    "k_grid_s": (("k_grid",), linear("k_grid", "k_supply", CK, "zero")),
    "k_grid_d": (("k_grid", "k_demand"), linear("k_grid", "k_demand", CK, "zero")),
    "k_ts": (("k_grid_s", "k_grid_d", "k_floor"), f"""SELECT g.curve_date, g.curve_hour, g.i, g.x AS price,
        coalesce(s.y, 0) + coalesce(f.y, 0) - coalesce(d.y, 0) AS volume FROM k_grid g
        LEFT JOIN k_grid_s s ON {_ON.format(a='s', b='g')} AND s.x = g.x
        LEFT JOIN k_grid_d d ON {_ON.format(a='d', b='g')} AND d.x = g.x
        LEFT JOIN k_floor f ON {_ON.format(a='f', b='g')}"""),
    "k_by_price": (("k_ts",), """SELECT curve_date, curve_hour, price AS x, max(volume) AS y FROM k_ts GROUP BY ALL"""),
    "k_by_volume": (("k_ts",), """SELECT curve_date, curve_hour, volume AS x, max(price) AS y FROM k_ts GROUP BY ALL"""),
    "k_asked": (("fx_curves",), """SELECT DISTINCT curve_date, curve_hour, price AS x FROM fx_curves"""),
    "k_implied": (("k_asked", "k_by_price"), linear("k_asked", "k_by_price", CK)),
    "k_ends": (("k_implied",), """SELECT curve_date, curve_hour, price, q, sgn,
        CASE WHEN sgn > 0 THEN v + q ELSE greatest(v - q, 0) END AS x FROM (
        SELECT curve_date, curve_hour, x AS price, y AS v FROM k_implied WHERE y IS NOT NULL) i,
        (SELECT unnest([500.0, 1000.0, 2000.0])::DOUBLE AS q) a, (SELECT unnest([1.0, -1.0])::DOUBLE AS sgn) b"""),
    "k_end_prices": (("k_ends", "k_by_volume"), linear("k_ends", "k_by_volume", CK)),
    "k_slopes": (("k_end_prices",), f"""SELECT e.curve_date, e.curve_hour, e.price,
        sum(sgn * y) FILTER (q = 500) / 1000 AS mo_slope_500,
        sum(sgn * y) FILTER (q = 1000) / 2000 AS mo_slope_1000,
        sum(sgn * y) FILTER (q = 2000) / 4000 AS mo_slope_2000 FROM k_ends e
        LEFT JOIN k_end_prices p ON {_ON.format(a='p', b='e')} AND p.x = e.x GROUP BY 1, 2, 3"""),
})
SLOPES = ("mo_slope_500", "mo_slope_1000", "mo_slope_2000")
POINTS = 500


def _ts(spark, sf):
    return K.transformed_supply(V.curves(spark, sf), POINTS)


def _edge_queries(c):
    # Below, on and above the price range of every curve, and halfway between steps.
    x = F.array(F.col("price") - 2.5, F.col("price"), F.col("price") + 2.5)
    return c.select(*CK, "side", F.explode(x).alias("x"))


@query(
    "j10_interp_clamp",
    linear(
        """(SELECT curve_date, curve_hour, side, price + d AS x FROM fx_curves,
           (SELECT unnest([-2.5, 0, 2.5])::DOUBLE AS d) t)""",
        "(SELECT curve_date, curve_hour, side, price AS x, volume AS y FROM fx_curves)",
        [*CK, "side"],
    ),
    ("fx_curves",),
    ("x", "y"),
)
def _j10c(spark, sf):
    c = V.curves(spark, sf)
    knots = c.select(*CK, "side", F.col("price").alias("x"), F.col("volume").alias("y"))
    return interp(_edge_queries(c), knots, [*CK, "side"])


@query(
    "j10_interp_zero",
    linear(
        """(SELECT curve_date, curve_hour, side, price + d AS x FROM fx_curves,
           (SELECT unnest([-2.5, 0, 2.5])::DOUBLE AS d) t)""",
        "(SELECT curve_date, curve_hour, side, price AS x, volume AS y FROM fx_curves)",
        [*CK, "side"],
        "zero",
    ),
    ("fx_curves",),
    ("x", "y"),
)
def _j10z(spark, sf):
    c = V.curves(spark, sf)
    knots = c.select(*CK, "side", F.col("price").alias("x"), F.col("volume").alias("y"))
    return interp(_edge_queries(c), knots, [*CK, "side"], outside="zero")


@query(
    "a24_curve_bounds",
    """SELECT curve_date, curve_hour, CASE WHEN side = 'Sell' THEN 'supply' ELSE 'demand' END AS kind,
       min(price) AS price_min, max(price) AS price_max, count(*) AS n_points FROM fx_curves GROUP BY 1, 2, 3""",
    ("fx_curves",),
)
def _a24(spark, sf):
    return K.curve_bounds(V.curves(spark, sf))


@query(
    "c1_transformed_supply",
    "SELECT curve_date, curve_hour, i, price, volume FROM k_ts",
    ("k_ts",),
    ("price", "volume"),
)
def _c1(spark, sf):
    return _ts(spark, sf)


@query(
    "c2_inelastic_demand",
    "SELECT curve_date, curve_hour, y AS inelastic_demand FROM k_floor",
    ("k_floor",),
    ("inelastic_demand",),
)
def _c2(spark, sf):
    return K.inelastic_demand(V.curves(spark, sf)).drop("x")


@query("c3_merit_order_slope", "SELECT * FROM k_slopes", ("k_slopes",), SLOPES)
def _c3(spark, sf):
    c = V.curves(spark, sf)
    return K.merit_order_slope(cut(_ts(spark, sf)), c.select(*CK, "price"))


def _curve_bins(spark, sf):
    """Bins over the curves' own calendar: each price step of a curve is a bin."""
    c = V.curves(spark, sf)
    return c.select(
        F.col("curve_date").alias("delivery_date"),
        F.col("curve_hour").alias("delivery_hour"),
        "side",
        F.col("price").alias("vwap"),
    )


@query(
    "c4_slopes_for_bins",
    """SELECT c.curve_date AS delivery_date, c.curve_hour AS delivery_hour, c.side, c.price AS vwap,
       mo_slope_500, mo_slope_1000, mo_slope_2000 FROM fx_curves c LEFT JOIN k_slopes s
       ON s.curve_date = c.curve_date AND s.curve_hour = c.curve_hour AND s.price = c.price""",
    ("fx_curves", "k_slopes"),
    SLOPES,
)
def _c4(spark, sf):
    return K.slopes_for_bins(_curve_bins(spark, sf), cut(_ts(spark, sf)))


@query(
    "j1_with_slopes",
    """SELECT b.delivery_date, b.delivery_hour, b.bin, s.mo_slope_500 FROM fx_bins b LEFT JOIN (
       SELECT delivery_date, delivery_hour, bin, vwap_changes / 1000 AS mo_slope_500 FROM fx_bins WHERE alpha = 1) s
       ON s.delivery_date = b.delivery_date AND s.delivery_hour = b.delivery_hour AND s.bin = b.bin""",
    ("fx_bins",),
    ("mo_slope_500",),
)
def _j1(spark, sf):
    from ..operators.features import with_slopes

    b = V.bins(spark, sf)
    s = b.filter(F.col("alpha") == 1).select(
        "delivery_date", "delivery_hour", "bin", (F.col("vwap_changes") / 1000).alias("mo_slope_500")
    )
    return with_slopes(b, s).select("delivery_date", "delivery_hour", "bin", "mo_slope_500")


VIEW_SQL.update({
    "k_inner": (("k_by_volume",), linear(
        """(SELECT curve_date, curve_hour, q AS x FROM k_by_volume,
           (SELECT unnest([500.0, 1000.0, 2000.0])::DOUBLE AS q) t)""", "k_by_volume", CK)),
    "k_el_ends": (("k_inner",), """SELECT curve_date, curve_hour, x AS q, sgn, y + sgn * x AS px FROM k_inner,
        (SELECT unnest([1.0, -1.0])::DOUBLE AS sgn) t"""),
    "k_el_prices": (("k_el_ends",), linear(
        "(SELECT curve_date, curve_hour, px AS x FROM k_el_ends)", "k_by_volume", CK)),
})


@query(
    "c5_elasticity",
    f"""SELECT e.curve_date, e.curve_hour, CAST(q AS INT) AS q, sum(sgn * y) / (2 * q) AS elasticity
        FROM k_el_ends e LEFT JOIN k_el_prices p ON {_ON.format(a='p', b='e')} AND p.x = e.px
        GROUP BY e.curve_date, e.curve_hour, q""",
    ("k_el_ends", "k_el_prices"),
    ("elasticity",),
)
def _c5(spark, sf):
    return K.elasticity_at(cut(_ts(spark, sf)))
