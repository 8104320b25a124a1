import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from ampertide.operators import reports as R
from ampertide.plans.features import FeatureConfig, prepare_features
from ampertide.sources import sinks as O

SPRING = dt.date(2021, 3, 28)


def _inputs(spark):
    base = dt.datetime(2021, 3, 28, 1)
    trades = []
    for i in range(40):
        start = base + dt.timedelta(hours=i % 5)
        trades.append(
            (i // 2, start - dt.timedelta(minutes=11 * (i % 20) + 3, seconds=i), start,
             start + dt.timedelta(hours=1), "CONT", "N", 20.0 + i % 7, 1.0 + i % 3)
        )
    t = spark.createDataFrame(
        trades,
        "trade_id long, exec_ts timestamp_ntz, delivery_start timestamp_ntz, delivery_end timestamp_ntz, "
        "trade_phase string, self_trade string, price double, qty_mw double",
    )
    da = spark.createDataFrame(
        [(SPRING, h, 30.0 + h) for h in range(24) if h != 2], "delivery_date date, delivery_hour int, price double"
    )
    pts = []
    for h in (3, 4):
        for i, p in enumerate(np.linspace(-500, 3000, 36)):
            pts.append((SPRING, h, "Sell", float(p), 1000.0 + 100 * i))
            pts.append((SPRING, h, "Purchase", float(p), 9000.0 - 50 * i))
    curves = spark.createDataFrame(pts, "curve_date date, curve_hour int, side string, price double, volume double")
    res = spark.createDataFrame(
        [(SPRING, 5, 7.0, 8.0)], "delivery_date date, delivery_hour int, wind_forecast double, solar_forecast double"
    )
    return t, da, curves, res


def test_features_of_a_year_with_clock_changes(spark, tmp_path):
    feats = prepare_features(spark, *_inputs(spark), FeatureConfig(year=2021, curve_points=50))
    O.write_features(feats, str(tmp_path / "f"))
    d = O.read_features(spark, str(tmp_path / "f"), [2021]).cache()
    assert d.count() == 365 * 24 * 16
    assert d.groupBy("delivery_date", "delivery_hour").count().filter("count <> 16").count() == 0
    assert d.filter("bin = 0 AND vwap_lag1 IS NOT NULL").count() == 0
    day = d.filter(F.col("delivery_date") == F.lit(SPRING))
    by_hour = {r.delivery_hour: r for r in day.filter("bin = 15").collect()}
    assert by_hour[2].da_price == by_hour[3].da_price == 33.0
    # The skipped hour borrows the curve of the next one, and the same trades.
    assert by_hour[2].mo_slope_500 is not None and by_hour[2].mo_slope_500 == by_hour[3].mo_slope_500
    assert by_hour[2].vwap == by_hour[3].vwap
    assert by_hour[9].mo_slope_500 is None and by_hour[5].wind_forecast == 7.0
    assert by_hour[3].SUN == 1 and by_hour[3].MON == 0 and by_hour[3].TTD_bin_1 == 1
    lost = day.filter("da_price IS NOT NULL AND bin > 0 AND vwap IS NULL AND delivery_hour <> 2").count()
    assert lost == 0
    spread = day.filter("delivery_hour = 3 AND bin = 15").select(
        F.abs(F.col("`da-id`") - (F.col("da_price") - F.col("vwap")))
    ).head()[0]
    assert spread == 0


def test_slopes_equal_numpy(spark):
    from ampertide.operators import curves as K

    _, _, curves, _ = _inputs(spark)
    ts = K.transformed_supply(curves.filter("curve_hour = 3"), 50)
    p = ts.orderBy("i").toPandas()
    s = curves.filter("curve_hour = 3 AND side = 'Sell'").orderBy("price").toPandas()
    q = curves.filter("curve_hour = 3 AND side = 'Purchase'").orderBy("price").toPandas()
    want = np.interp(p.price, s.price, s.volume, left=0, right=0) + np.interp(-500, q.price, q.volume) - np.interp(
        p.price, q.price, q.volume, left=0, right=0
    )
    assert np.allclose(p.volume, want)
    asks = spark.createDataFrame([(SPRING, 3, v) for v in (-600.0, 0.0, 37.5, 5000.0)], "curve_date date, curve_hour int, price double")
    for r in K.merit_order_slope(ts, asks).collect():
        v = np.interp(r.price, p.price, p.volume)
        for step in (500, 1000, 2000):
            up = np.interp(v + step, p.volume, p.price)
            dn = np.interp(max(v - step, 0), p.volume, p.price)
            assert abs(r[f"mo_slope_{step}"] - (up - dn) / (2 * step)) < 1e-9


def test_prediction_vintages(spark):
    d = spark.createDataFrame([(25, 14, 1.0, 1.0, -2.0), (3, 1, 2.0, 4.0, -1.0)],
                              "hour int, ttd int, abs_err double, sq_err double, log_score double")
    got = R.normalize_predictions(d, "zi").orderBy("abs_error").collect()
    assert [(r.hour, r.which_hour_before, r.log_score) for r in got] == [(23, 4, 2.0), (3, 1, 1.0)]
    try:
        R.normalize_predictions(d.drop("sq_err"), "zi")
        raise AssertionError("expected an error")
    except ValueError:
        pass
