"""Clock, join and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock as C
from ..functions.labels import complete_day_hours, interpolate_hours, unpivot_hours
from ..functions.numeric import guarded_ratio, guarded_reciprocal, log1p_checked
from ..operators import features as X
from ..operators.curves import merit_order_slope, slopes_for_bins, transformed_supply  # noqa: F401
from . import views as V
from .registry import query

ZONE = "Europe/Amsterdam"
KEY = ["delivery_date", "delivery_hour", "bin"]


@query(
    "f1_parse_instant",
    f"""SELECT event_id, ts + CASE event_id % 3 WHEN 0 THEN to_minutes(0) WHEN 1 THEN to_minutes(-60)
        ELSE to_minutes(330) END AS instant, timezone('{ZONE}', timezone('UTC', ts + CASE event_id % 3
        WHEN 0 THEN to_minutes(0) WHEN 1 THEN to_minutes(-60) ELSE to_minutes(330) END)) AS local_ts
        FROM events""",
)
def _f1(spark, sf):
    e = V.table(spark, sf, "events")
    m = F.col("event_id") % 3
    text = F.concat(
        F.translate(F.col("ts").cast("string"), " ", "T"),
        F.when(m == 0, "Z").when(m == 1, "+01:00").otherwise("-05:30"),
    )
    d = e.select("event_id", C.parse_instant(text).alias("instant"))
    return d.withColumn("local_ts", C.to_local(F.col("instant")))


@query(
    "f2_calendar_parts",
    """SELECT o_orderkey, CAST(extract(hour FROM t) AS INT) AS hour, CAST(isodow(t) - 1 AS INT) AS weekday,
       CAST(extract(year FROM t) AS INT) AS year, CAST(t AS DATE) AS day FROM (SELECT o_orderkey,
       timezone('Europe/Amsterdam', timezone('UTC', o_orderdate)) AS t FROM orders) x""",
)
def _f2(spark, sf):
    o = V.table(spark, sf, "orders").select(
        "o_orderkey", C.to_local(F.col("o_orderdate")).alias("t")
    )
    return o.select(
        "o_orderkey", F.hour("t").alias("hour"), F.weekday("t").alias("weekday"),
        F.year("t").alias("year"), F.to_date("t").alias("day"),
    )


@query(
    "f3_weekday_flags",
    """SELECT o_orderkey, CAST(isodow(o_orderdate) = 1 AS INT) AS "MON", CAST(isodow(o_orderdate) = 6 AS INT)
       AS "SAT", CAST(isodow(o_orderdate) = 7 AS INT) AS "SUN" FROM orders""",
)
def _f3(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return X.with_calendar(o, "d").drop("d")


def _days(spark, sf):
    return V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


@query(
    "f4_clock_change_days",
    f"""SELECT day, secs AS seconds, secs <> 86400 AS is_change, secs < 86400 AS is_spring,
        secs > 86400 AS is_autumn FROM (SELECT day, CAST(epoch(timezone('{ZONE}', CAST(day + 1 AS TIMESTAMP)))
        - epoch(timezone('{ZONE}', CAST(day AS TIMESTAMP))) AS BIGINT) AS secs
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) d) x""",
)
def _f4(spark, sf):
    d = F.col("day")
    return _days(spark, sf).select(
        "day",
        C.day_seconds(d).alias("seconds"),
        C.is_clock_change(d).alias("is_change"),
        C.is_spring_change(d).alias("is_spring"),
        C.is_autumn_change(d).alias("is_autumn"),
    )


@query(
    "f5_effective_start",
    f"""SELECT day, hour, CASE WHEN timezone('{ZONE}', timezone('UTC', i - INTERVAL 1 HOUR)) = wall
        THEN i - INTERVAL 1 HOUR ELSE i END AS instant FROM (SELECT *, timezone('UTC', timezone('{ZONE}', wall))
        AS i FROM (SELECT day, CAST(h AS INT) AS hour, CAST(day AS TIMESTAMP) + to_hours(CAST(h AS INT)) AS wall
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) d,
        (SELECT unnest(range(24)) AS h) t) w) x""",
)
def _f5(spark, sf):
    d = _days(spark, sf).select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return d.select("day", "hour", C.effective_start(F.col("day"), F.col("hour")).alias("instant"))


@query(
    "f6_bin_axis",
    """SELECT delivery_date, delivery_hour, CAST(delivery_date AS TIMESTAMP) + to_hours(delivery_hour)
       - INTERVAL 4 HOUR + to_minutes(CAST(15 * b AS INT)) AS bin_ts FROM fx_hours,
       (SELECT unnest(range(16)) AS b) t""",
    ("fx_hours",),
)
def _f6(spark, sf):
    h = V.delivery_hours(spark, sf)
    start = C.at_hour(F.col("delivery_date"), F.col("delivery_hour"))
    return h.select(
        "delivery_date", "delivery_hour", F.explode(C.bin_axis(start, 4, 15)).alias("bin_ts")
    )


@query(
    "f7_ttd",
    """SELECT delivery_date, delivery_hour, bin, CAST(16 - bin AS DOUBLE) AS "TTD_bins",
       1 / sqrt(17.0 - bin) AS "f_TTD" FROM fx_bins""",
    ("fx_bins",),
    ("TTD_bins", "f_TTD"),
)
def _f7(spark, sf):
    return X.with_ttd(V.bins(spark, sf)).select(*KEY, "TTD_bins", "f_TTD")


@query(
    "f8_ttd_one_hot",
    "SELECT delivery_date, delivery_hour, bin, "
    + ", ".join(f'CAST(16 - bin = {k} AS INT) AS "TTD_bin_{k}"' for k in range(1, 17))
    + ", CAST(16 - bin AS INT) AS ttd_idx FROM fx_bins",
    ("fx_bins",),
)
def _f8(spark, sf):
    d = X.ttd_one_hot(X.with_ttd(V.bins(spark, sf)), 16)
    return X.ttd_from_one_hot(d, 16).select(
        *KEY, *[f"TTD_bin_{k}" for k in range(1, 17)], "ttd_idx"
    )


def _lag(c, k):
    return f"lag({c}, {k}) OVER (PARTITION BY delivery_date, delivery_hour ORDER BY bin)"


@query(
    "w1_add_lags",
    "SELECT delivery_date, delivery_hour, bin, vwap, "
    + ", ".join(f"{_lag('vwap', k)} AS vwap_lag{k}" for k in (1, 2, 3))
    + ", alpha, "
    + ", ".join(f"{_lag('alpha', k)} AS alpha_lag{k}" for k in range(1, 13))
    + " FROM fx_bins",
    ("fx_bins",),
    ("vwap", "vwap_lag1", "vwap_lag2", "vwap_lag3"),
)
def _w1(spark, sf):
    d = V.bins(spark, sf).select(*KEY, "vwap", "alpha")
    return X.add_lags(d, {"vwap": [1, 2, 3], "alpha": list(range(1, 13))})


@query(
    "f9_abs_and_lag_sums",
    """SELECT delivery_date, delivery_hour, bin, abs(vwap_changes) AS abs_vwap_changes, """
    + " + ".join(_lag("abs(vwap_changes)", k) for k in range(5, 9))
    + " AS abs_vwap_changes_lag5_8, "
    + " + ".join(_lag("abs(vwap_changes)", k) for k in range(7, 13))
    + " AS abs_vwap_changes_lag7_12 FROM fx_bins",
    ("fx_bins",),
    ("abs_vwap_changes", "abs_vwap_changes_lag5_8", "abs_vwap_changes_lag7_12"),
)
def _f9(spark, sf):
    d = X.add_abs(V.bins(spark, sf).select(*KEY, "vwap_changes"), ["vwap_changes"])
    d = X.add_lags(d, {"abs_vwap_changes": list(range(1, 13))})
    d = X.lag_sum(X.lag_sum(d, "abs_vwap_changes", 5, 8), "abs_vwap_changes", 7, 12)
    return d.select(
        *KEY, "abs_vwap_changes", "abs_vwap_changes_lag5_8", "abs_vwap_changes_lag7_12"
    )


_SPREAD_SQL = (
    'SELECT b.delivery_date, b.delivery_hour, b.bin, a.price - vwap AS "da-id", '
    "a.price - {l1} AS \"da-id_lag1\", a.price - {l2} AS \"da-id_lag2\", abs(a.price - {l1}) AS abs_spread "
    "FROM fx_bins b LEFT JOIN fx_da a ON a.delivery_date = b.delivery_date "
    "AND a.delivery_hour = b.delivery_hour"
).format(
    l1="lag(vwap, 1) OVER (PARTITION BY b.delivery_date, b.delivery_hour ORDER BY bin)",
    l2="lag(vwap, 2) OVER (PARTITION BY b.delivery_date, b.delivery_hour ORDER BY bin)",
)


@query(
    "f10_spread",
    _SPREAD_SQL,
    ("fx_bins", "fx_da"),
    ("da-id", "da-id_lag1", "da-id_lag2", "abs_spread"),
)
def _f10(spark, sf):
    d = X.with_da_price(V.bins(spark, sf), V.day_ahead(spark, sf))
    d = X.add_lags(d, {"vwap": [1, 2]})
    signed = X.add_spread(d)
    both = signed.withColumn("abs_spread", F.abs(F.col("da_price") - F.col("vwap_lag1")))
    return both.select(*KEY, "da-id", "da-id_lag1", "da-id_lag2", "abs_spread")


@query(
    "f12_log1p",
    "SELECT trade_id, ln(1 + price) AS log_price FROM fx_trades",
    ("fx_trades",),
    ("log_price",),
)
def _f12(spark, sf):
    return V.trades(spark, sf).select(
        "trade_id", log1p_checked(F.col("price"), "price").alias("log_price")
    )


@query(
    "f13_hour_labels",
    """SELECT delivery_date, delivery_hour, avg(price) AS price FROM (
       SELECT delivery_date, delivery_hour, price FROM fx_da UNION ALL
       SELECT delivery_date, delivery_hour, price + 1 FROM fx_da WHERE delivery_hour = 2) t GROUP BY 1, 2""",
    ("fx_da",),
    ("price",),
)
def _f13(spark, sf):
    da = V.day_ahead(spark, sf)
    labels = [f"Hour {k}" for k in range(1, 25) if k != 3] + ["Hour 3A"]
    h = F.col("delivery_hour") + 1
    label = F.concat(F.lit("Hour "), h.cast("string"), F.when(h == 3, "A").otherwise(""))
    wide = (
        da.select("delivery_date", label.alias("label"), "price")
        .groupBy("delivery_date").pivot("label", labels).agg(F.first("price"))
        .withColumn("Hour 3B", F.col("Hour 3A") + 1)
    )
    return unpivot_hours(wide, "delivery_date", "mean").filter(F.col("price").isNotNull())


@query(
    "f20_safe_division",
    """SELECT trade_id, CASE WHEN abs(qty_mw) >= 1e-12 THEN price / nullif(qty_mw, 0) ELSE sign(price) * 1e12 END
       AS ratio, CASE WHEN abs(qty_mw) >= 1e-12 THEN 1 / nullif(qty_mw, 0) ELSE 1e12 END AS inverse
       FROM fx_trades""",
    ("fx_trades",),
    ("ratio", "inverse"),
    digits=9,
)
def _f20(spark, sf):
    p, q = F.col("price"), F.col("qty_mw")
    return V.trades(spark, sf).select(
        "trade_id", guarded_ratio(p, q).alias("ratio"), guarded_reciprocal(q).alias("inverse")
    )


@query(
    "j2_with_res",
    """SELECT b.delivery_date, b.delivery_hour, b.bin, wind_forecast, solar_forecast FROM fx_bins b
       LEFT JOIN fx_res r ON r.delivery_date = b.delivery_date AND r.delivery_hour = b.delivery_hour""",
    ("fx_bins", "fx_res"),
    ("wind_forecast", "solar_forecast"),
)
def _j2(spark, sf):
    d = X.with_res(V.bins(spark, sf), V.forecasts(spark, sf))
    return d.select(*KEY, "wind_forecast", "solar_forecast")


@query(
    "j3_with_da_price",
    """SELECT b.delivery_date, b.delivery_hour, b.bin, a.price AS da_price FROM fx_bins b
       LEFT JOIN fx_da a ON a.delivery_date = b.delivery_date AND a.delivery_hour = b.delivery_hour""",
    ("fx_bins", "fx_da"),
    ("da_price",),
)
def _j3(spark, sf):
    return X.with_da_price(V.bins(spark, sf), V.day_ahead(spark, sf)).select(*KEY, "da_price")


@query(
    "j4_outer_suffix_join",
    """SELECT coalesce(a.delivery_start, b.delivery_start) AS delivery_start, a.volume AS volume_fc,
       b.volume AS volume_act, a.n, b.high FROM
       (SELECT delivery_start, sum(qty_mw) AS volume, count(*) AS n FROM fx_trades WHERE side = 'BUY'
        GROUP BY 1) a FULL OUTER JOIN
       (SELECT delivery_start, sum(qty_mw) AS volume, max(price) AS high FROM fx_trades WHERE side = 'SELL'
        GROUP BY 1) b ON a.delivery_start = b.delivery_start""",
    ("fx_trades",),
    ("volume_fc", "volume_act", "high"),
)
def _j4(spark, sf):
    t = V.trades(spark, sf)
    a = t.filter(F.col("side") == "BUY").groupBy("delivery_start").agg(
        F.sum("qty_mw").alias("volume"), F.count(F.lit(1)).alias("n")
    )
    b = t.filter(F.col("side") == "SELL").groupBy("delivery_start").agg(
        F.sum("qty_mw").alias("volume"), F.max("price").alias("high")
    )
    return X.outer_suffix_join(a, b, ["delivery_start"], "_fc", "_act")


@query(
    "w5_interpolate_hours",
    """SELECT delivery_date, delivery_hour, CASE WHEN v IS NOT NULL THEN v
       WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo + (delivery_hour - lh) * (hi - lo) / (hh - lh)
       ELSE coalesce(lo, hi) END AS solar_forecast FROM (SELECT delivery_date, delivery_hour, solar_forecast AS v,
       last_value(solar_forecast IGNORE NULLS) OVER p AS lo, first_value(solar_forecast IGNORE NULLS) OVER f AS hi,
       last_value(CASE WHEN solar_forecast IS NOT NULL THEN delivery_hour END IGNORE NULLS) OVER p AS lh,
       first_value(CASE WHEN solar_forecast IS NOT NULL THEN delivery_hour END IGNORE NULLS) OVER f AS hh
       FROM (SELECT d.delivery_date, CAST(h AS INT) AS delivery_hour, r.solar_forecast FROM
         (SELECT DISTINCT delivery_date FROM fx_res) d CROSS JOIN (SELECT unnest(range(24)) AS h) t
         LEFT JOIN fx_res r ON r.delivery_date = d.delivery_date AND r.delivery_hour = h) g
       WINDOW p AS (PARTITION BY delivery_date ORDER BY delivery_hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       f AS (PARTITION BY delivery_date ORDER BY delivery_hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) w""",
    ("fx_res",),
    ("solar_forecast",),
)
def _w5(spark, sf):
    r = V.forecasts(spark, sf).select("delivery_date", "delivery_hour", "solar_forecast")
    return interpolate_hours(complete_day_hours(r), "solar_forecast")


@query(
    "w13_response_lags",
    """SELECT * FROM (SELECT trade_id, price, lag(price, 1) OVER w AS price_lag1, lag(price, 2) OVER w AS price_lag2,
       lag(price, 3) OVER w AS price_lag3 FROM fx_trades WINDOW w AS (ORDER BY exec_ts, trade_id)) t
       QUALIFY row_number() OVER (ORDER BY trade_id) > 3""",
    ("fx_trades",),
)
def _w13(spark, sf):
    t = V.trades(spark, sf).select("trade_id", "exec_ts", "price")
    cell = F.to_date("exec_ts")
    return X.response_lags(t, "price", 3, ["exec_ts", "trade_id"], cell).drop("exec_ts")


@query(
    "j9_shift_hour",
    """SELECT delivery_date, delivery_hour, CAST(delivery_date + CAST(floor((delivery_hour - 2) / 24.0) AS INT) AS DATE)
       AS prev_date, CAST((delivery_hour + 22) % 24 AS INT) AS prev_hour, CAST(delivery_date +
       CAST(floor((delivery_hour + 2) / 24.0) AS INT) AS DATE) AS next_date, CAST((delivery_hour + 2) % 24 AS INT)
       AS next_hour FROM fx_hours""",
    ("fx_hours",),
)
def _j9(spark, sf):
    day, hour = F.col("delivery_date"), F.col("delivery_hour")
    (pd_, ph), (nd, nh) = C.shift_hour(day, hour, -2), C.shift_hour(day, hour, 2)
    return V.delivery_hours(spark, sf).select(
        "delivery_date", "delivery_hour", pd_.alias("prev_date"), ph.alias("prev_hour"),
        nd.alias("next_date"), nh.alias("next_hour"),
    )


def _ttd_rows(spark, sf):
    return V.bins(spark, sf).withColumn("ttd", 16 - F.col("bin"))


@query(
    "a7_delta_lookup",
    """SELECT delivery_date, delivery_hour, CAST(16 - bin AS INT) AS ttd, avg(vwap_changes) AS delta FROM fx_bins
       GROUP BY 1, 2, 3""",
    ("fx_bins",),
    ("delta",),
)
def _a7(spark, sf):
    return X.delta_lookup(_ttd_rows(spark, sf))


def _neighbor_sql():
    parts = []
    for o in (-2, -1, 1, 2):
        name = f"nb_dchg_{'m' if o < 0 else 'p'}{abs(o)}"
        parts.append(
            f"""coalesce((SELECT arg_min(n.vwap_changes, 16 - n.bin) FROM fx_bins n
            WHERE CAST(n.delivery_date AS TIMESTAMP) + to_hours(n.delivery_hour)
                = CAST(b.delivery_date AS TIMESTAMP) + to_hours(b.delivery_hour + ({o}))
            AND CASE WHEN 16 - b.bin + {4 * o} < 1 THEN n.bin = 15
                     ELSE 16 - b.bin + {4 * o} <= 16 AND 16 - n.bin >= 16 - b.bin + {4 * o} END), 0) AS {name}"""
        )
    return "SELECT delivery_date, delivery_hour, bin, " + ", ".join(parts) + " FROM fx_bins b"


@query(
    "j8_neighbor_features",
    _neighbor_sql(),
    ("fx_bins",),
    ("nb_dchg_m2", "nb_dchg_m1", "nb_dchg_p1", "nb_dchg_p2"),
)
def _j8(spark, sf):
    return X.neighbor_features(_ttd_rows(spark, sf)).select(
        *KEY, "nb_dchg_m2", "nb_dchg_m1", "nb_dchg_p1", "nb_dchg_p2"
    )


@query(
    "p8_last_hours",
    "SELECT delivery_date, delivery_hour, bin, vwap FROM fx_bins WHERE 16 - bin <= 8",
    ("fx_bins",),
    ("vwap",),
)
def _p8(spark, sf):
    return X.last_hours(X.with_ttd(V.bins(spark, sf)), 2).select(*KEY, "vwap")


@query(
    "p9_design_columns",
    """SELECT trade_id, coalesce(ln(nullif(qty_mw, 0)), 0) AS log_qty, coalesce(price / nullif(qty_mw, 0), 0)
       AS ratio, CAST(0 AS DOUBLE) AS absent FROM fx_trades""",
    ("fx_trades",),
    ("log_qty", "ratio"),
    digits=9,
)
def _p9(spark, sf):
    t = V.trades(spark, sf)
    q = F.col("qty_mw")
    raw = t.select(
        "trade_id",
        F.when(q == 0, F.lit(float("-inf"))).otherwise(F.log(q)).alias("log_qty"),
        F.when(q == 0, F.lit(float("nan"))).otherwise(F.try_divide("price", q)).alias("ratio"),
    )
    return X.design_columns(raw, ["log_qty", "ratio", "absent"])


@query(
    "p10_drop_nulls",
    """SELECT * FROM fx_res WHERE wind_forecast IS NOT NULL AND solar_forecast IS NOT NULL""",
    ("fx_res",),
    ("wind_forecast", "solar_forecast"),
)
def _p10(spark, sf):
    return V.forecasts(spark, sf).na.drop(subset=["wind_forecast", "solar_forecast"])
