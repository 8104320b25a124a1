"""Source and sink queries: derived tables are written in the input formats to the
shared scratch folder and read back with the readers."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import reports as R
from ..session import scratch_path
from ..sources import readers as I
from ..sources.archives import file_system
from ..sources import sinks as O
from . import reports as RQ
from . import views as V
from .registry import query

_VINTAGE_2 = [
    "DeliveryStart", "DeliveryEnd", "ExecutionTime", "Volume", "TradeId", "SelfTrade", "TradePhase",
    "Side", "Price",
]
_TAPE_SQL = """SELECT trade_id, exec_ts, delivery_start, delivery_end, trade_phase, self_trade, side, price, qty_mw
    FROM fx_trades"""


def _iso(col):
    return F.concat(F.translate(F.col(col).cast("string"), " ", "T"), F.lit("Z"))


def _vintage_2(spark, sf):
    return V.trades(spark, sf).select(
        _iso("delivery_start").alias("DeliveryStart"),
        _iso("delivery_end").alias("DeliveryEnd"),
        _iso("exec_ts").alias("ExecutionTime"),
        F.col("qty_mw").cast("string").alias("Volume"),
        F.col("trade_id").cast("string").alias("TradeId"),
        F.col("self_trade").alias("SelfTrade"),
        F.col("trade_phase").alias("TradePhase"),
        F.col("side").alias("Side"),
        F.col("price").cast("string").alias("Price"),
    )


@query(
    "s1_read_trades",
    f"""{_TAPE_SQL} UNION ALL SELECT trade_id, exec_ts, delivery_start, delivery_end, trade_phase, self_trade,
        NULL, price, qty_mw FROM fx_trades""",
    ("fx_trades",),
)
def _s1(spark, sf):
    root = scratch_path(spark, "trades")
    two = _vintage_2(spark, sf)
    two.write.option("header", "true").csv(f"{root}/v2")
    one = two.select(
        F.col("DeliveryStart").alias("Delivery Start"), F.col("DeliveryEnd").alias("Delivery End"),
        F.col("ExecutionTime").alias("Execution time"), F.col("TradeId").alias("TradeID"),
        F.col("SelfTrade").alias("Is Self Trade"), "Price", F.col("Volume").alias("Quantity (MW)"),
        "TradePhase",
    )
    one.write.option("header", "true").csv(f"{root}/v1")
    return I.read_trades(spark, [f"{root}/v1", f"{root}/v2"])


def _zip_batches(batches):
    for k, pdf in enumerate(batches):
        inner = io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr("trades.csv", "Banner line\n" + pdf.to_csv(index=False))
        outer = io.BytesIO()
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("inner.zip", inner.getvalue())
        yield pd.DataFrame({"path": [f"batch-{k}.zip"], "content": [outer.getvalue()]})


@query("s2_read_zipped_trades", _TAPE_SQL, ("fx_trades",))
def _s2(spark, sf):
    # One archive (a zip in a zip) per Arrow batch of the whole tape.
    files = _vintage_2(spark, sf).mapInPandas(_zip_batches, "path string, content binary")
    return I._typed_trades(I.zipped_csv(files))


def _zip_files(folder):
    def write(batches):
        from pyspark import TaskContext

        system, place = file_system(folder)
        for k, pdf in enumerate(batches):
            half = len(pdf) // 2
            inner = io.BytesIO()
            with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("trades.csv", "Banner line\n" + pdf[:half].to_csv(index=False))
            # A task that runs again writes the same file.
            name = f"{place}/tape-{TaskContext.get().partitionId()}-{k}.zip"
            with system.open_output_stream(name) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("inner.zip", inner.getvalue())
                z.writestr("rest.csv", "Banner line\n" + pdf[half:].to_csv(index=False))
            yield pd.DataFrame({"file": [name]})

    return write


@query("s2_read_archive_members", _TAPE_SQL, ("fx_trades",))
def _s2_members(spark, sf):
    # The whole tape as archive files, half of each in an archive inside, read back by member.
    folder = scratch_path(spark, "archives")
    system, place = file_system(folder)
    system.create_dir(place, recursive=True)
    _vintage_2(spark, sf).mapInPandas(_zip_files(folder), "file string").write.format("noop").mode("overwrite").save()
    return I.read_zipped_trades(spark, folder)


@query(
    "s3_read_auction_wide",
    "SELECT delivery_date, delivery_hour, price FROM fx_da",
    ("fx_da",),
    ("price",),
)
def _s3(spark, sf):
    h = F.col("delivery_hour") + 1
    label = F.concat(F.lit("Hour "), h.cast("string"), F.when(h == 3, "A").otherwise(""))
    labels = [f"Hour {k}" for k in range(1, 25) if k != 3] + ["Hour 3A"]
    wide = (
        V.day_ahead(spark, sf).withColumn("l", label)
        .groupBy(F.date_format("delivery_date", "dd/MM/yyyy").alias("Delivery day"))
        .pivot("l", labels).agg(F.first("price"))
    )
    path = scratch_path(spark, "auction")
    wide.withColumn("Hour 3B", F.lit(None).cast("double")).write.option("header", "true").csv(path)
    return I.read_auction_wide(spark, path).filter(F.col("price").isNotNull())


def _curve_text(spark, sf):
    c = V.curves(spark, sf)
    hour = F.col("curve_hour")
    return c.select(
        F.date_format("curve_date", "dd/MM/yyyy").alias("Date"),
        F.when(hour == 3, "3A").when(hour == 4, "3B").otherwise(hour.cast("string")).alias("Hour"),
        F.col("side").alias("Sale/Purchase"),
        F.col("price").cast("string").alias("Price"),
        F.col("volume").cast("string").alias("Volume"),
    )


@query(
    "s4_read_curves",
    """SELECT curve_date, CAST(curve_hour - 1 AS INT) AS curve_hour, side, price, volume FROM fx_curves
       WHERE curve_hour <> 4""",
    ("fx_curves",),
)
def _s4(spark, sf):
    path = scratch_path(spark, "curves")
    _curve_text(spark, sf).write.option("header", "true").csv(path)
    return I.read_curves(spark, path)


@query(
    "s5_read_res_forecast",
    """SELECT delivery_date, delivery_hour, wind_forecast FROM fx_res""",
    ("fx_res",),
    ("wind_forecast",),
)
def _s5(spark, sf):
    from ..functions.clock import at_hour

    path = scratch_path(spark, "res")
    stamp = F.date_format(at_hour(F.col("delivery_date"), F.col("delivery_hour")), "dd/MM/yyyy HH:mm")
    rows = V.forecasts(spark, sf).select(
        F.concat(F.lit("["), stamp, F.lit("]")).alias("Date (CET)"),
        F.col("wind_forecast").cast("string").alias("WIND DA FORECAST (TENNET)"),
    )
    units = spark.range(1).select(
        F.lit("").alias("Date (CET)"), F.lit("MW").alias("WIND DA FORECAST (TENNET)")
    )
    rows.unionByName(units).write.option("header", "true").csv(path)
    return I.read_res_forecast(spark, path, "wind")


@query(
    "s6_contract_stats",
    """SELECT strftime(s, '%H:%M') || ' - ' || strftime(s + to_minutes(duration_min), '%H:%M') AS delivery_period,
       CASE WHEN duration_min = 60 THEN 'SIDC' ELSE 'Local' END AS market, duration_min AS resolution_minutes,
       high, low, vwap, CAST(NULL AS DOUBLE) AS vwap_3h, CAST(NULL AS DOUBLE) AS vwap_1h, open, close,
       buy_volume, sell_volume, volume, strftime(o, '%Y-%m-%d %H:%M:%S') AS open_time,
       strftime(s, '%Y-%m-%d %H:%M:%S') AS close_time FROM (
       SELECT duration_min, delivery_start + INTERVAL 1 HOUR AS s, date_trunc('second', min(exec_ts)) + INTERVAL 1 HOUR AS o,
       max(price) AS high, min(price) AS low, sum(price * qty_mw) / nullif(sum(qty_mw), 0) AS vwap,
       arg_min(price, trade_id) AS open, arg_max(price, trade_id) AS close,
       coalesce(sum(qty_mw) FILTER (side = 'BUY'), 0) AS buy_volume,
       coalesce(sum(qty_mw) FILTER (side = 'SELL'), 0) AS sell_volume, sum(qty_mw) AS volume
       FROM fx_trades GROUP BY delivery_start, duration_min) t""",
    ("fx_trades",),
    ("high", "low", "vwap", "open", "close", "buy_volume", "sell_volume", "volume"),
)
def _s6(spark, sf):
    t = V.trades(spark, sf)
    p, q = F.col("price"), F.col("qty_mw")
    per = t.groupBy("delivery_start", "delivery_end", "duration_min").agg(
        F.max(p).alias("highPrice"), F.min(p).alias("lowPrice"),
        F.try_divide(F.sum(p * q), F.sum(q)).alias("averagePrice"),
        F.min_by(p, "trade_id").alias("openPrice"), F.max_by(p, "trade_id").alias("closePrice"),
        F.coalesce(F.sum(F.when(F.col("side") == "BUY", q)), F.lit(0.0)).alias("buyVolume"),
        F.coalesce(F.sum(F.when(F.col("side") == "SELL", q)), F.lit(0.0)).alias("sellVolume"),
        F.sum(q).alias("volume"), F.min("exec_ts").alias("first_ts"),
    )
    contract = F.struct(
        (F.col("duration_min") != 60).alias("isLocalContract"),
        _iso("delivery_start").alias("deliveryStart"), _iso("delivery_end").alias("deliveryEnd"),
        _iso("first_ts").alias("contractOpenTime"), _iso("delivery_start").alias("contractCloseTime"),
        "highPrice", "lowPrice", "averagePrice", "openPrice", "closePrice", "buyVolume", "sellVolume",
        "volume",
    )
    # At most three products per start: a small array per document.
    docs = per.groupBy("delivery_start").agg(F.collect_list(contract).alias("contracts"))
    return I.flatten_contract_stats(docs.select(F.to_json(F.struct("contracts")).alias("doc")), "doc")


@query(
    "s7_area_volumes",
    """SELECT delivery_start, strftime(delivery_start + INTERVAL 1 HOUR, '%H:%M') || ' - ' ||
       strftime(delivery_start + INTERVAL 2 HOUR, '%H:%M') AS delivery_period,
       sum(qty_mw) FILTER (side = 'BUY' AND duration_min = 60) AS "NL Buy (MW)",
       sum(qty_mw) FILTER (side = 'SELL' AND duration_min = 60) AS "NL Sell (MW)",
       sum(qty_mw) FILTER (side = 'BUY' AND duration_min < 60) AS "DE Buy (MW)",
       sum(qty_mw) FILTER (side = 'SELL' AND duration_min < 60) AS "DE Sell (MW)"
       FROM fx_trades GROUP BY 1""",
    ("fx_trades",),
    ("NL Buy (MW)", "NL Sell (MW)", "DE Buy (MW)", "DE Sell (MW)"),
)
def _s7(spark, sf):
    from ..functions.clock import shift_minutes

    q = F.col("qty_mw")
    area = F.when(F.col("duration_min") == 60, "NL").otherwise("DE")
    per = V.trades(spark, sf).groupBy("delivery_start", area.alias("area")).agg(
        F.sum(F.when(F.col("side") == "BUY", q)).alias("buy"),
        F.sum(F.when(F.col("side") == "SELL", q)).alias("sell"),
    )
    # Two areas per start.
    hours = per.groupBy("delivery_start").agg(
        F.map_from_entries(F.collect_list(F.struct("area", F.struct("buy", "sell")))).alias("entryPerArea")
    )
    hours = hours.withColumn("end", shift_minutes(F.col("delivery_start"), 60))
    entry = F.struct(
        _iso("delivery_start").alias("deliveryStart"), _iso("end").alias("deliveryEnd"), "entryPerArea"
    )
    docs = hours.select(F.to_json(F.struct(F.array(entry).alias("multiAreaEntries"))).alias("doc"))
    return I.flatten_area_volumes(docs, "doc", ["NL", "DE"])


@query(
    "s8_file_date_range",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate AS DATE) + 30 AS last_day
       FROM orders""",
)
def _s8(spark, sf):
    d = F.to_date("o_orderdate")
    name = F.concat(
        F.lit("trades_"), F.date_format(d, "yyyyMMdd"), F.lit("-"),
        F.date_format(F.date_add(d, 30), "yyyyMMdd"), F.lit(".zip"),
    )
    o = V.table(spark, sf, "orders").select("o_orderkey", name.alias("file"))
    return I.file_date_range(o, "file").drop("file")


@query(
    "s9_features_by_year",
    """SELECT delivery_date, delivery_hour, bin, vwap FROM fx_bins WHERE extract(year FROM delivery_date) = 2024""",
    ("fx_bins",),
    ("vwap",),
)
def _s9(spark, sf):
    path = scratch_path(spark, "features")
    O.write_features(V.bins(spark, sf), path)
    return O.read_features(spark, path, [2024]).select("delivery_date", "delivery_hour", "bin", "vwap")


@query(
    "s11_write_predictions",
    "SELECT source, hour, which_hour_before, timestamp, abs_error, 'c1' AS chunk_id FROM fx_scored",
    ("fx_scored",),
    ("abs_error",),
)
def _s11(spark, sf):
    d = RQ.scored(spark, sf).select(
        "source", "hour", "which_hour_before", "timestamp", "abs_error",
        F.to_date("timestamp").alias("date"),
    )
    path = scratch_path(spark, "predictions")
    O.write_predictions(d, path, "c1", "parquet")
    return spark.read.parquet(path).drop("date")


@query(
    "s12_write_summary",
    """SELECT source, avg(abs_error) AS "MAE", sqrt(avg(sq_error)) AS "RMSE" FROM fx_scored GROUP BY 1""",
    ("fx_scored",),
    ("MAE", "RMSE"),
)
def _s12(spark, sf):
    path = scratch_path(spark, "summary")
    O.write_summary(R.summary_table(RQ.scored(spark, sf)), path)
    schema = "source string, MAE double, RMSE double, LogScore double, CRPS double"
    return spark.read.schema(schema).option("header", "true").csv(path).select("source", "MAE", "RMSE")
