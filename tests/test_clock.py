import datetime as dt

from pyspark.sql import functions as F

from ampertide.functions import clock as C
from ampertide.operators import bins as B

ZONE = "Europe/Amsterdam"


def test_change_days_of_2021(spark):
    days = B.year_calendar(spark, 2021).select("delivery_date").distinct()
    got = {
        r.delivery_date: r.s
        for r in days.select("delivery_date", C.day_seconds(F.col("delivery_date")).alias("s"))
        .filter("s <> 86400").collect()
    }
    assert got == {dt.date(2021, 3, 28): 82800, dt.date(2021, 10, 31): 90000}


def test_effective_start_on_change_days(spark):
    d = spark.createDataFrame(
        [(dt.date(2021, 3, 28), 2), (dt.date(2021, 3, 28), 3), (dt.date(2021, 10, 31), 2), (dt.date(2021, 10, 31), 3)],
        "d date, h int",
    )
    got = [r[0] for r in d.select(C.effective_start(F.col("d"), F.col("h"))).collect()]
    assert got == [
        dt.datetime(2021, 3, 28, 1), dt.datetime(2021, 3, 28, 1),
        dt.datetime(2021, 10, 31, 0), dt.datetime(2021, 10, 31, 2),
    ]


def test_wall_bins_ignore_the_change(spark):
    grid = B.contract_grid(B.year_calendar(spark, 2021), zone=ZONE)
    assert grid.count() == 365 * 24 * 16
    row = grid.filter("delivery_date = '2021-03-28' AND delivery_hour = 4 AND bin = 0").head()
    assert row.bin_timestamp == dt.datetime(2021, 3, 28, 0)
    assert row.bin_timestamp_real == dt.datetime(2021, 3, 27, 22)


def test_session_zone_does_not_matter(spark):
    d = spark.createDataFrame([(dt.date(2021, 3, 14), 2)], "d date, h int")
    out = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        out.append(
            d.select(
                C.micros(C.at_hour(F.col("d"), F.col("h"))),
                C.parse_instant(F.lit("2021-03-14T02:30:00+05:30")).cast("string"),
            ).head()
        )
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert out[0] == out[1]
    assert out[0][1] == "2021-03-13 21:00:00"


def test_spring_hours_share_trades_and_seed(spark):
    start = dt.datetime(2021, 3, 28, 1)
    trades = spark.createDataFrame(
        [(start - dt.timedelta(minutes=20), start, 10.0, 2.0), (start - dt.timedelta(minutes=50), start, 20.0, 0.0)],
        "exec_ts timestamp_ntz, delivery_start timestamp_ntz, price double, qty_mw double",
    )
    da = spark.createDataFrame([(dt.date(2021, 3, 28), 3, 7.0)], "delivery_date date, delivery_hour int, price double")
    hours = B.year_calendar(spark, 2021).filter("delivery_date = '2021-03-28' AND delivery_hour IN (2, 3, 5)")
    got = B.bin_series(trades, da, hours, zone=ZONE).orderBy("delivery_hour", "bin").collect()
    h2, h3, h5 = got[:16], got[16:32], got[32:]
    assert [r.alpha for r in h3] == [0] * 12 + [1, 0, 1, 0] == [r.alpha for r in h2]
    assert [r.vwap for r in h3] == [7.0] * 14 + [10.0] * 2
    assert h3[14].vwap_changes == 3.0
    assert h2[0].vwap is None and h2[15].vwap == 10.0
    assert all(r.vwap is None and r.alpha == 0 for r in h5)
