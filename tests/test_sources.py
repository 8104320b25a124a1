import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ampertide.functions.labels import interpolate_hours, unpivot_hours
from ampertide.operators import tape as T
from ampertide.sources import readers as I
from ampertide.sources.archives import archive_lines
from ampertide.sources import sinks as O

V1 = """Delivery Start,Delivery End,Execution time,TradeID,Is Self Trade,Price,Quantity (MW)
2021-03-28T01:00:00Z,2021-03-28T02:00:00Z,2021-03-28T00:10:00+01:00,1,N,10.5,2
2021-03-28T01:00:00Z,2021-03-28T01:30:00Z,2021-03-28T00:20:00Z,2,,11.5,3
"""
V2 = """Some banner, with text
DeliveryStart,DeliveryEnd,ExecutionTime,Volume,TradeId,SelfTrade,TradePhase,Side,Price
2022-01-01T01:00:00Z,2022-01-01T02:00:00Z,2022-01-01T00:10:00Z,4,7,N,CONT,BUY,20
2022-01-01T01:00:00Z,2022-01-01T02:00:00Z,2022-01-01T00:11:00Z,4,8,Y,CONT,BUY,20
2022-01-01T01:00:00Z,2022-01-01T02:00:00Z,2022-01-01T00:12:00Z,4,9,N,AUCT,SELL,20
"""


def test_trade_vintages(spark, tmp_path):
    (tmp_path / "a.csv").write_text(V1)
    (tmp_path / "b.csv").write_text(V2)
    one = I.read_trades(spark, [str(tmp_path / "a.csv")])
    assert "trade_phase" not in one.columns
    assert {r.trade_id for r in T.clean_tape(one).collect()} == {1, 2}
    assert one.filter("trade_id = 1").head().exec_ts == dt.datetime(2021, 3, 27, 23, 10)
    two = I.read_trades(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert two.count() == 5
    assert {r.trade_id for r in T.clean_tape(two).collect()} == {7}
    assert [r.trade_id for r in T.of_product(T.with_duration(one), "half_hourly").collect()] == [2]
    with pytest.raises(ValueError):
        T.of_product(one, "weekly")


def test_zip_in_zip(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.csv", V2)
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("y.csv", V2.replace(",7,", ",17,"))
        z.writestr("notes.txt", "not a csv")
    got = I.read_zipped_trades(spark, str(tmp_path / "*.zip"))
    assert sorted(r.trade_id for r in got.collect()) == [7, 8, 8, 9, 9, 17]


def test_archives_are_read_by_member(spark, tmp_path):
    deep = io.BytesIO()
    with zipfile.ZipFile(deep, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(3):
            z.writestr(f"d{k}.csv", V2.replace(",7,", f",{70 + k},"))
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(5):
            z.writestr(f"m{k}.csv", f"x\n{k}\n")
        z.writestr("empty.csv", "")
        z.writestr("deep.zip", deep.getvalue())
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("n.CSV", "\ufeffx\r\n9\r\n\r\n")
    lines = archive_lines(spark, str(tmp_path))
    # A partition per member with content: five and the inner archive of a, one of b.
    assert lines.rdd.getNumPartitions() == 7
    got = {(r.member, r.value) for r in lines.collect()}
    assert {v for m, v in got if m == "n.CSV"} == {"x", "9"}
    assert {m for m, _ in got if m.startswith("deep")} == {f"deep.zip/d{k}.csv" for k in range(3)}
    assert archive_lines(spark, "file:" + str(tmp_path / "b*.zip")).count() == 2
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    assert archive_lines(spark, str(tmp_path / "none.zip")).count() == 0


def test_a_broken_member_is_named(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("good.csv", "x\n1\n")
        z.writestr("bad.csv", "y" * 500)
    data = bytearray((tmp_path / "c.zip").read_bytes())
    at = data.index(b"y" * 500)
    data[at : at + 3] = b"zzz"
    (tmp_path / "c.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="c.zip: bad.csv"):
        archive_lines(spark, str(tmp_path / "c.zip")).count()
    (tmp_path / "d.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="d.zip"):
        archive_lines(spark, str(tmp_path / "d.zip")).count()


def test_auction_wide_and_modes(spark, tmp_path):
    cols = ["Hour 1", "Hour 2", "Hour 3A", "Hour 3B"] + [f"Hour {k}" for k in range(4, 25)]
    line = ",".join(["31/10/2021"] + [str(i) for i in range(25)])
    (tmp_path / "p.csv").write_text("banner\nDelivery day," + ",".join(cols) + f"\n{line}\nnotes,,\n")
    first = {r.delivery_hour: r.price for r in I.read_auction_wide(spark, str(tmp_path / "p.csv")).collect()}
    mean = {r.delivery_hour: r.price for r in I.read_auction_wide(spark, str(tmp_path / "p.csv"), "mean").collect()}
    assert len(first) == 24 and first[2] == 2.0 and mean[2] == 2.5 and first[3] == 4.0 and first[23] == 24.0


def test_res_forecast_change_days(spark, tmp_path):
    rows = ["[28/03/2021 00:00],1", "[28/03/2021 01:00],2", "[28/03/2021 03:00],4", "[31/10/2021 02:00],5",
            "[31/10/2021 02:00],6", "[31/12/2020 23:00],9"]
    (tmp_path / "w.csv").write_text("Date (CET),WIND DA FORECAST (TENNET)\n,MW\n" + "\n".join(rows) + "\n")
    got = {
        (r.delivery_date, r.delivery_hour): r.wind_forecast
        for r in I.read_res_forecast(spark, str(tmp_path / "w.csv"), "wind", 2021).collect()
    }
    s, a = dt.date(2021, 3, 28), dt.date(2021, 10, 31)
    assert got == {(s, 0): 1.0, (s, 1): 2.0, (s, 2): 4.0, (s, 3): 4.0, (a, 2): 5.0}


def test_file_name_without_range_is_an_error(spark):
    d = spark.createDataFrame([("trades_20210101-20210131.zip",), ("trades.zip",)], "f string")
    assert I.file_date_range(d.limit(1), "f").head().last_day == dt.date(2021, 1, 31)
    with pytest.raises(Exception, match="no date range"):
        I.file_date_range(d, "f").collect()


def test_hours_interpolate_inside_a_day(spark):
    d = spark.createDataFrame(
        [("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 4, 8.0), ("a", 5, None), ("b", 0, None)],
        "delivery_date string, delivery_hour int, price double",
    )
    got = [r.price for r in interpolate_hours(d, "price").orderBy("delivery_date", "delivery_hour").collect()]
    assert got == [2.0, 2.0, 4.0, 8.0, 8.0, None]


def test_parameter_status(spark, tmp_path):
    from ampertide.schema import PARAMS

    day = dt.date(2024, 1, 1)
    ok = (day, 1, 2, "ecm", True, None, 5.0, 9, 1, ["y"], [0.0], [[1.0]], [[1.0]], [0.0], [1.0], True, 4)
    bad = (day, 2, 2, "ecm", False, "singular", *[None] * 11)
    O.save_params(spark.createDataFrame([ok, bad], PARAMS), str(tmp_path / "p"), {"a": 1})
    keys = spark.createDataFrame([(day, h, 2) for h in (1, 2, 3)], "date date, hour int, which_hour_before int")
    got = {r.hour: (r.status, r.error) for r in O.get_params(O.load_params(spark, str(tmp_path / "p")), keys).collect()}
    assert got == {1: ("ok", None), 2: ("failed", "singular"), 3: ("missing", None)}


def test_archives_in_a_table_are_copied_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("y.csv", V2 + "padding\n" * 100_000)
    batch = pa.RecordBatch.from_arrays([pa.array([f"{k}.zip" for k in range(40)]), pa.array([buffer.getvalue()] * 40)], names=["path", "content"])
    tracemalloc.start()
    lines = sum(part.num_rows for part in I._zip_lines([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lines == 40 * 100_005 and peak < 10 * len(buffer.getvalue())


def test_zipped_lines_of_a_table(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("y.csv", V2)
    files = spark.createDataFrame([("a.zip", buffer.getvalue()), ("b.zip", buffer.getvalue())], "path string, content binary")
    got = I.zipped_lines(files)
    assert got.columns == ["value", "member", "archive"]
    assert sorted({(r.member, r.archive) for r in got.collect()}) == [("y.csv", "a.zip"), ("y.csv", "b.zip")]
    assert got.count() == 10
