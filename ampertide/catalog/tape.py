"""Tape, grid and ordered-scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock as C
from ..operators import bins as B
from ..operators import features as X
from ..operators import tape as T
from ..operators.curves import combine
from . import views as V
from .registry import query

_TRADE = "trade_id, exec_ts, delivery_start, duration_min, side, price, qty_mw"
_TRADE_COLS = [c.strip() for c in _TRADE.split(",")]


@query(
    "bin_series",
    "SELECT delivery_date, delivery_hour, bin, bin_timestamp, vwap, vwap_changes, alpha FROM fx_bins",
    ("fx_bins",),
    ("vwap", "vwap_changes"),
)
def _bin_series(spark, sf):
    return V.bins(spark, sf).select(
        "delivery_date", "delivery_hour", "bin", "bin_timestamp", "vwap", "vwap_changes", "alpha"
    )


@query(
    "p1_clean_tape",
    f"SELECT {_TRADE} FROM fx_trades WHERE trade_phase = 'CONT' AND self_trade IS DISTINCT FROM 'Y'",
    ("fx_trades",),
)
def _p1(spark, sf):
    return T.clean_tape(V.trades(spark, sf)).select(*_TRADE_COLS)


@query(
    "p2_of_product",
    f"SELECT {_TRADE}, CAST(duration_min AS DOUBLE) AS duration FROM fx_trades WHERE duration_min = 30",
    ("fx_trades",),
)
def _p2(spark, sf):
    d = T.with_duration(V.trades(spark, sf))
    return T.of_product(d, "half_hourly").select(*_TRADE_COLS, "duration")


@query(
    "p3_product_type",
    """SELECT trade_id, CASE duration_min WHEN 60 THEN 'hourly' WHEN 30 THEN 'half_hourly'
       ELSE 'quarterly' END AS product_type FROM fx_trades""",
    ("fx_trades",),
)
def _p3(spark, sf):
    return T.with_product_type(T.with_duration(V.trades(spark, sf))).select("trade_id", "product_type")


@query(
    "p4_of_year",
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE extract(year FROM o_orderdate) = 1997",
)
def _p4(spark, sf):
    d = T.of_year(V.table(spark, sf, "orders"), 1997, "o_orderdate")
    return d.select("o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "p5_drop_hours",
    f"SELECT {_TRADE} FROM fx_trades WHERE extract(hour FROM delivery_start) NOT IN (2, 3)",
    ("fx_trades",),
)
def _p5(spark, sf):
    return T.drop_hours(V.trades(spark, sf), [2, 3]).select(*_TRADE_COLS)


@query(
    "w7_dedupe",
    f"""SELECT {_TRADE} FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY exec_ts, price)
        AS rn FROM (SELECT * FROM fx_trades UNION ALL SELECT * REPLACE (exec_ts + INTERVAL 1 SECOND AS exec_ts,
        price + 1 AS price) FROM fx_trades) u) r WHERE rn = 1""",
    ("fx_trades",),
)
def _w7(spark, sf):
    t = V.trades(spark, sf)
    second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1))
    again = t.withColumn("exec_ts", F.col("exec_ts") + second).withColumn("price", F.col("price") + 1)
    copies = t.unionByName(again).select(*_TRADE_COLS)
    return T.dedupe(copies, ["trade_id"], [F.col("exec_ts"), F.col("price")])


@query(
    "w8_first_occurrence",
    """SELECT delivery_date, delivery_hour, wind_forecast FROM (
       SELECT *, row_number() OVER (PARTITION BY delivery_date, delivery_hour ORDER BY dst DESC, wind_forecast)
       AS rn FROM (SELECT delivery_date, delivery_hour, wind_forecast, 1 AS dst FROM fx_res UNION ALL
       SELECT delivery_date, delivery_hour, solar_forecast, 0 FROM fx_res) u) r WHERE rn = 1""",
    ("fx_res",),
    ("wind_forecast",),
)
def _w8(spark, sf):
    r = V.forecasts(spark, sf)
    keys = ["delivery_date", "delivery_hour"]
    first = r.select(*keys, "wind_forecast", F.lit(1).alias("dst"))
    second = r.select(*keys, F.col("solar_forecast").alias("wind_forecast"), F.lit(0).alias("dst"))
    d = T.dedupe(first.unionByName(second), keys, [-F.col("dst"), F.col("wind_forecast")])
    return d.drop("dst")


@query(
    "a1_vwap",
    """SELECT delivery_start, duration_min, CASE WHEN sum(qty_mw) > 0 THEN sum(price * qty_mw) / sum(qty_mw)
       END AS vwap FROM fx_trades GROUP BY 1, 2""",
    ("fx_trades",),
    ("vwap",),
)
def _a1(spark, sf):
    from ..functions.numeric import vwap

    t = V.trades(spark, sf)
    return t.groupBy("delivery_start", "duration_min").agg(
        vwap(F.col("price"), F.col("qty_mw")).alias("vwap")
    )


@query("a2_bin_vwap", "SELECT delivery_start, bin, bin_vwap, n FROM fx_binned", ("fx_binned",), ("bin_vwap",))
def _a2(spark, sf):
    return B.bin_vwap(V.clean_hourly(spark, sf))


@query(
    "a3_tick_vwap",
    """SELECT delivery_start, exec_ts, CASE WHEN min(price) = max(price) THEN min(price)
       WHEN sum(qty_mw) > 0 THEN sum(price * qty_mw) / sum(qty_mw) END AS vwap, sum(qty_mw) AS qty_mw
       FROM (SELECT delivery_start, date_trunc('minute', exec_ts) AS exec_ts, price, qty_mw FROM fx_trades) t
       GROUP BY 1, 2""",
    ("fx_trades",),
    ("vwap", "qty_mw"),
)
def _a3(spark, sf):
    t = V.trades(spark, sf)
    minute = F.col("exec_ts") - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.extract(F.lit("SECOND"), F.col("exec_ts"))
    )
    return T.tick_vwap(t.withColumn("exec_ts", minute))


@query(
    "a4_trade_time_counts",
    """SELECT CAST(delivery_date AS TIMESTAMP) + to_hours(delivery_hour) AS hour_start,
       count(DISTINCT exec_ts) AS n_times FROM fx_hours LEFT JOIN fx_trades
       ON date_trunc('hour', exec_ts) = CAST(delivery_date AS TIMESTAMP) + to_hours(delivery_hour) GROUP BY 1""",
    ("fx_hours", "fx_trades"),
)
def _a4(spark, sf):
    hours = V.delivery_hours(spark, sf).select(
        C.at_hour(F.col("delivery_date"), F.col("delivery_hour")).alias("hour_start")
    )
    return T.trade_time_counts(V.trades(spark, sf), hours)


@query(
    "a5_side_volume",
    "SELECT side, sum(qty_mw) AS volume FROM fx_trades GROUP BY 1",
    ("fx_trades",),
    ("volume",),
)
def _a5(spark, sf):
    return T.side_volume(V.trades(spark, sf))


@query(
    "a6_volume_by_hour",
    """SELECT CAST(extract(hour FROM delivery_start) AS INT) AS delivery_hour,
       coalesce(sum(qty_mw) FILTER (duration_min = 60), 0) AS hourly,
       coalesce(sum(qty_mw) FILTER (duration_min = 30), 0) AS half_hourly,
       coalesce(sum(qty_mw) FILTER (duration_min = 15), 0) AS quarterly FROM fx_trades GROUP BY 1""",
    ("fx_trades",),
    ("hourly", "half_hourly", "quarterly"),
)
def _a6(spark, sf):
    return T.volume_by_hour(T.with_duration(V.trades(spark, sf)))


@query(
    "j13_contract_grid",
    "SELECT delivery_date, delivery_hour, bin, bin_timestamp, delivery_start_wall FROM fx_grid",
    ("fx_grid",),
)
def _j13(spark, sf):
    return B.contract_grid(V.delivery_hours(spark, sf)).select(
        "delivery_date", "delivery_hour", "bin", "bin_timestamp", "delivery_start_wall"
    )


@query(
    "j11_contract_pairs",
    """SELECT delivery_start, volume, lead(delivery_start) OVER (ORDER BY delivery_start) AS next_start,
       lead(volume) OVER (ORDER BY delivery_start) AS next_volume
       FROM (SELECT delivery_start, sum(qty_mw) AS volume FROM fx_trades GROUP BY 1) t
       QUALIFY next_start IS NOT NULL""",
    ("fx_trades",),
    ("volume", "next_volume"),
)
def _j11(spark, sf):
    c = V.trades(spark, sf).groupBy("delivery_start").agg(F.sum("qty_mw").alias("volume"))
    return X.contract_pairs(c, ["volume"]).select(
        "delivery_start", "volume", "next_start", "next_volume"
    )


@query(
    "w2_ffill",
    """SELECT g.delivery_date, g.delivery_hour, g.bin, last_value(bin_vwap IGNORE NULLS) OVER (
       PARTITION BY g.delivery_date, g.delivery_hour ORDER BY g.bin
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vwap
       FROM fx_grid g LEFT JOIN fx_binned b ON b.delivery_start = g.delivery_start_wall AND b.bin = g.bin""",
    ("fx_grid", "fx_binned"),
    ("vwap",),
)
def _w2(spark, sf):
    return B.ffill(_gappy(spark, sf), "vwap")


def _gappy(spark, sf):
    grid = B.contract_grid(V.delivery_hours(spark, sf))
    return grid.join(
        B.bin_vwap(V.clean_hourly(spark, sf)), ["delivery_start", "bin"], "left"
    ).select("delivery_date", "delivery_hour", "bin", F.col("bin_vwap").alias("vwap"))


@query(
    "w3_diff0",
    """SELECT delivery_date, delivery_hour, bin, coalesce(vwap - lag(vwap) OVER (
       PARTITION BY delivery_date, delivery_hour ORDER BY bin), 0) AS d FROM fx_bins""",
    ("fx_bins",),
    ("d",),
)
def _w3(spark, sf):
    return B.diff0(V.bins(spark, sf), "vwap", "d").select(
        "delivery_date", "delivery_hour", "bin", "d"
    )


@query(
    "w4_empty_window",
    """SELECT g.delivery_date, g.delivery_hour, count(bin_vwap) = 0 AS is_empty FROM fx_grid g
       LEFT JOIN fx_binned b ON b.delivery_start = g.delivery_start_wall AND b.bin = g.bin GROUP BY 1, 2""",
    ("fx_grid", "fx_binned"),
)
def _w4(spark, sf):
    return _gappy(spark, sf).groupBy("delivery_date", "delivery_hour").agg(
        (F.count("vwap") == 0).alias("is_empty")
    )


@query(
    "w6_first_vwap",
    """SELECT delivery_date, delivery_hour, arg_min(vwap, bin) AS first_vwap FROM fx_bins
       WHERE vwap IS NOT NULL GROUP BY 1, 2""",
    ("fx_bins",),
    ("first_vwap",),
)
def _w6(spark, sf):
    return B.first_vwap(V.bins(spark, sf))


@query(
    "u1_union",
    """SELECT trade_id, side, price, CAST(NULL AS DOUBLE) AS da FROM fx_trades UNION ALL
       SELECT NULL, NULL, price, price FROM fx_da""",
    ("fx_trades", "fx_da"),
    ("price", "da"),
)
def _u1(spark, sf):
    a = V.trades(spark, sf).select("trade_id", "side", "price")
    b = V.day_ahead(spark, sf).select("price", F.col("price").alias("da"))
    return combine(a, b)


@query(
    "o4_delivery_starts",
    "SELECT DISTINCT delivery_start FROM fx_trades ORDER BY 1",
    ("fx_trades",),
)
def _o4(spark, sf):
    return V.trades(spark, sf).select("delivery_start").distinct().orderBy("delivery_start")


@query(
    "o1_sorted_bins",
    "SELECT delivery_date, delivery_hour, bin, vwap FROM fx_bins ORDER BY 1, 2, 3",
    ("fx_bins",),
    ("vwap",),
)
def _o1(spark, sf):
    d = V.bins(spark, sf).select("delivery_date", "delivery_hour", "bin", "vwap")
    return d.orderBy("delivery_date", "delivery_hour", "bin")


@query(
    "f11_da_bands",
    """SELECT t.trade_id, t.price, a.price AS da_price, a.price * 1.3 AS da_upper, a.price * 0.7 AS da_lower,
       t.price BETWEEN a.price * 0.7 AND a.price * 1.3 AS inside_band FROM fx_trades t
       JOIN fx_da a ON a.delivery_date = CAST(t.delivery_start AS DATE)
       AND a.delivery_hour = extract(hour FROM t.delivery_start)""",
    ("fx_trades", "fx_da"),
    ("da_price", "da_upper", "da_lower"),
    digits=9,
)
def _f11(spark, sf):
    t = V.trades(spark, sf).select(
        "trade_id", "price", F.to_date("delivery_start").alias("delivery_date"),
        F.hour("delivery_start").alias("delivery_hour"),
    )
    da = V.day_ahead(spark, sf).withColumnRenamed("price", "da_price")
    d = t.join(da, ["delivery_date", "delivery_hour"])
    return T.da_bands(d, "price", "da_price").drop("delivery_date", "delivery_hour")
