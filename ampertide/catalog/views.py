"""The driver tables seen as market data, in Spark and in check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import shift_minutes, trunc_hour
from ..operators import bins as B
from ..operators import tape as T


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    start = shift_minutes(trunc_hour(F.col("ts")), (1 + F.col("event_id") % 5) * 60)
    bucket = F.col("user_id") % 10
    duration = F.when(bucket < 7, 60).when(bucket < 9, 30).otherwise(15)
    return e.select(
        F.col("event_id").alias("trade_id"),
        F.col("ts").alias("exec_ts"),
        start.alias("delivery_start"),
        shift_minutes(start, duration).alias("delivery_end"),
        duration.alias("duration_min"),
        F.when(F.col("event_type") == "error", "AUCT").otherwise("CONT").alias("trade_phase"),
        F.when(F.col("event_type") == "signup", "Y").otherwise("N").alias("self_trade"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.col("value").alias("price"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("qty_mw"),
    )


def day_ahead(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.to_date("ts").alias("delivery_date"), F.hour("ts").alias("delivery_hour"))
        .agg(F.avg("value").alias("price"))
    )


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    def of(kind):
        return F.sum(F.when(F.col("event_type") == kind, F.col("value")))

    return (
        table(spark, sf, "events")
        .groupBy(F.to_date("ts").alias("delivery_date"), F.hour("ts").alias("delivery_hour"))
        .agg(of("view").alias("wind_forecast"), of("click").alias("solar_forecast"))
    )


def curves(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("l_linestatus") == "O", "Sell").otherwise("Purchase")
    steps = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.trunc("l_shipdate", "year").alias("curve_date"),
            F.col("l_linenumber").alias("curve_hour"),
            side.alias("side"),
            (F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 500) * 5 - 500)
            .cast("double")
            .alias("price"),
        )
        .agg(F.sum("l_quantity").alias("v"))
    )
    # One row per price step by now: at most some hundreds per curve.
    w = (
        W.partitionBy("curve_date", "curve_hour", "side")
        .orderBy(F.when(F.col("side") == "Sell", F.col("price")).otherwise(-F.col("price")))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return steps.select(
        "curve_date", "curve_hour", "side", "price", F.sum("v").over(w).alias("volume")
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Each value forecast by the mean of the previous day's hour of its source."""
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("source"),
        F.hour("ts").alias("hour"),
        (1 + F.col("event_id") % 4).cast("int").alias("which_hour_before"),
        F.col("ts").alias("timestamp"),
        F.to_date("ts").alias("day"),
        F.col("value").alias("y_true"),
    )
    past = e.groupBy("source", "hour", F.date_add("day", 1).alias("day")).agg(
        F.avg("y_true").alias("mu_cond"), F.var_pop("y_true").alias("var_cond")
    )
    return e.join(past, ["source", "hour", "day"]).drop("day")


def clean_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return T.of_product(T.clean_tape(trades(spark, sf)), "hourly", "duration_min")


def delivery_hours(spark: SparkSession, sf: str) -> DataFrame:
    days = clean_hourly(spark, sf).agg(
        F.to_date(F.min("delivery_start")).alias("first_day"),
        F.to_date(F.max("delivery_start")).alias("last_day"),
    )
    return B.calendar(days)


def bins(spark: SparkSession, sf: str) -> DataFrame:
    return B.bin_series(
        clean_hourly(spark, sf), day_ahead(spark, sf), delivery_hours(spark, sf)
    )


VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_trades": ((), """
        SELECT *, delivery_start + to_minutes(duration_min) AS delivery_end FROM (
        SELECT event_id AS trade_id, ts AS exec_ts,
          date_trunc('hour', ts) + to_hours(CAST(1 + event_id % 5 AS INT)) AS delivery_start,
          CAST(CASE WHEN user_id % 10 < 7 THEN 60 WHEN user_id % 10 < 9 THEN 30 ELSE 15 END AS INT)
            AS duration_min,
          CASE WHEN event_type = 'error' THEN 'AUCT' ELSE 'CONT' END AS trade_phase,
          CASE WHEN event_type = 'signup' THEN 'Y' ELSE 'N' END AS self_trade,
          CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
          value AS price, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS qty_mw
        FROM events)"""),
    "fx_da": ((), """
        SELECT CAST(ts AS DATE) AS delivery_date, CAST(extract(hour FROM ts) AS INT) AS delivery_hour,
          avg(value) AS price FROM events GROUP BY 1, 2"""),
    "fx_res": ((), """
        SELECT CAST(ts AS DATE) AS delivery_date, CAST(extract(hour FROM ts) AS INT) AS delivery_hour,
          sum(CASE WHEN event_type = 'view' THEN value END) AS wind_forecast,
          sum(CASE WHEN event_type = 'click' THEN value END) AS solar_forecast
        FROM events GROUP BY 1, 2"""),
    "fx_curves": ((), """
        SELECT curve_date, curve_hour, side, CAST(price AS DOUBLE) AS price,
          sum(v) OVER (PARTITION BY curve_date, curve_hour, side
                       ORDER BY CASE WHEN side = 'Sell' THEN price ELSE -price END
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS volume
        FROM (SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS curve_date,
                     CAST(l_linenumber AS INT) AS curve_hour,
                     CASE WHEN l_linestatus = 'O' THEN 'Sell' ELSE 'Purchase' END AS side,
                     floor(l_extendedprice / l_quantity / 500) * 5 - 500 AS price,
                     sum(l_quantity) AS v
              FROM lineitem GROUP BY 1, 2, 3, 4) t"""),
    "fx_preds": ((), """
        SELECT e.event_type AS source, CAST(extract(hour FROM e.ts) AS INT) AS hour,
          CAST(1 + e.event_id % 4 AS INT) AS which_hour_before, e.ts AS timestamp,
          e.value AS y_true, p.mu_cond, p.var_cond
        FROM events e JOIN (
          SELECT event_type, CAST(extract(hour FROM ts) AS INT) AS h,
            CAST(ts AS DATE) + 1 AS d, avg(value) AS mu_cond, var_pop(value) AS var_cond
          FROM events GROUP BY 1, 2, 3) p
        ON p.event_type = e.event_type AND p.h = extract(hour FROM e.ts) AND p.d = CAST(e.ts AS DATE)"""),
    "fx_hourly": (("fx_trades",), """
        SELECT * FROM fx_trades WHERE trade_phase = 'CONT' AND self_trade IS DISTINCT FROM 'Y'
          AND duration_min = 60"""),
    "fx_hours": (("fx_hourly",), """
        SELECT CAST(d AS DATE) AS delivery_date, CAST(h AS INT) AS delivery_hour FROM (
          SELECT unnest(generate_series(CAST(min(delivery_start) AS DATE)::TIMESTAMP,
            CAST(max(delivery_start) AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM fx_hourly) x,
          (SELECT unnest(range(24)) AS h) y"""),
    "fx_binned": (("fx_hourly",), """
        SELECT delivery_start, bin, CASE WHEN sum(qty_mw) > 0 THEN sum(price * qty_mw) / sum(qty_mw) END
          AS bin_vwap, count(*) AS n
        FROM (SELECT *, CAST(floor((epoch_us(exec_ts) - epoch_us(delivery_start) + 14400000000)
                / 900000000.0) AS INT) AS bin FROM fx_hourly) t
        WHERE bin BETWEEN 0 AND 15 GROUP BY 1, 2"""),
    "fx_grid": (("fx_hours",), """
        SELECT delivery_date, delivery_hour,
          CAST(delivery_date AS TIMESTAMP) + to_hours(delivery_hour) AS delivery_start_wall,
          CAST(b AS INT) AS bin,
          CAST(delivery_date AS TIMESTAMP) + to_hours(delivery_hour) - INTERVAL 4 HOUR
            + to_minutes(CAST(15 * b AS INT)) AS bin_timestamp
        FROM fx_hours, (SELECT unnest(range(16)) AS b) t"""),
    "fx_bins": (("fx_grid", "fx_binned", "fx_da"), """
        SELECT delivery_date, delivery_hour, delivery_start_wall, bin, bin_timestamp, vwap,
          coalesce(vwap - lag(vwap) OVER (PARTITION BY delivery_date, delivery_hour ORDER BY bin), 0)
            AS vwap_changes,
          CAST(CASE WHEN n IS NOT NULL AND known > 0 THEN 1 ELSE 0 END AS INT) AS alpha
        FROM (SELECT *, count(bin_vwap) OVER (PARTITION BY delivery_date, delivery_hour) AS known,
            last_value(seeded IGNORE NULLS) OVER (PARTITION BY delivery_date, delivery_hour ORDER BY bin
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vwap
          FROM (SELECT g.*, b.bin_vwap, b.n,
                  CASE WHEN b.bin_vwap IS NULL AND g.bin = 0 THEN a.price ELSE b.bin_vwap END AS seeded
                FROM fx_grid g
                LEFT JOIN fx_binned b ON b.delivery_start = g.delivery_start_wall AND b.bin = g.bin
                LEFT JOIN fx_da a ON a.delivery_date = g.delivery_date
                  AND a.delivery_hour = g.delivery_hour) s) f"""),
}
