"""File and JSON sources."""

from __future__ import annotations

import csv
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import (
    MARKET_ZONE,
    iso_day_first,
    is_spring_change,
    micros,
    parse_instant,
    to_local,
)
from ..functions.labels import hour_of_label, unpivot_hours
from ..operators.curves import combine
from ..operators.tape import dedupe
from ..schema import AREA_VOLUMES, CONTRACT_STATS, TRADE_COLUMNS, TRADE_RENAMES, TRADE_TIMES, TRADE_TYPES
from .archives import archive_lines


def _names(header: str) -> list[str]:
    return [c.strip().lstrip("﻿") for c in next(csv.reader([header]))]


def _parse_lines(lines: DataFrame, header: str, extra: list[str] = ()) -> DataFrame:
    """Text lines -> string columns named by the header line."""
    names = _names(header)
    ddl = ", ".join(f"`{n}` string" for n in names)
    rows = lines.filter(F.col("value") != header)
    return rows.select(F.from_csv("value", ddl).alias("r"), *extra).select("r.*", *extra)


def csv_below_banner(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """A CSV whose header, the first line that holds `marker`, may follow a banner.

    Only that line comes to the driver; files stay splittable. Banner lines parse
    to rows without keys, which every reader below drops."""
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").contains(marker)).select("value").head()
    if head is None:
        raise ValueError(f"no header with '{marker}' in {path}")
    return _parse_lines(lines, head["value"])


def _typed_trades(raw: DataFrame) -> DataFrame:
    d = raw.select(
        *[F.col(f"`{c}`").alias(TRADE_RENAMES[c]) for c in raw.columns if c in TRADE_RENAMES]
    )
    for c in TRADE_TIMES:
        d = d.withColumn(c, parse_instant(F.col(c)))
    for c, t in TRADE_TYPES.items():
        d = d.withColumn(c, F.col(c).try_cast(t))
    for c in TRADE_COLUMNS:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    return d.select(*TRADE_COLUMNS).filter(F.col("trade_id").isNotNull())


def read_trades(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Trade CSVs of either vintage, with or without a banner, as one tape.

    Times become UTC instants. A path may be a folder or glob of one vintage."""
    raw = [csv_below_banner(spark, p, "Delivery") for p in paths]
    out = combine(*[_typed_trades(d) for d in raw])
    # A tape without any phase would lose all rows to the phase filter.
    phased = any("TradePhase" in d.columns for d in raw)
    return out if phased else out.drop("trade_phase")


def _zip_lines(batches):
    """Lines of every CSV in each archive, archives in archives included, in
    bounded chunks. Members are streamed, never held as text; of an Arrow batch
    one archive at a time is copied."""

    def walk(handle, name):
        with zipfile.ZipFile(handle) as z:
            for member in sorted(z.namelist()):
                low = member.lower()
                if low.endswith(".zip"):
                    yield from walk(io.BytesIO(z.read(member)), member)
                elif low.endswith(".csv"):
                    with z.open(member) as raw:
                        chunk = []
                        for line in io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""):
                            text = line.rstrip("\r\n")
                            if text:
                                chunk.append(text)
                            if len(chunk) == 20000:
                                yield member, chunk
                                chunk = []
                        if chunk:
                            yield member, chunk

    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            path = path.as_py()
            for member, chunk in walk(io.BytesIO(content.as_py()), path):
                n = len(chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk, pa.string()), pa.array([member] * n, pa.string()), pa.array([path] * n, pa.string())],
                    names=["value", "member", "archive"],
                )


def zipped_lines(files: DataFrame) -> DataFrame:
    """(value, member, archive) lines of the archives in `files(path, content)`.

    For archives that stand in a table; files are read by member (sources/archives.py)."""
    return files.select("path", "content").mapInArrow(
        _zip_lines, "value string, member string, archive string"
    )


def zipped_csv(files: DataFrame, marker: str = "Delivery") -> DataFrame:
    """Zipped CSVs that share one header, as string columns."""
    return _one_header(zipped_lines(files), marker)


def _one_header(lines: DataFrame, marker: str) -> DataFrame:
    head = lines.filter(F.col("value").contains(marker)).select("value").head()
    if head is None:
        raise ValueError(f"no header with '{marker}' in the archives")
    return _parse_lines(lines, head["value"])


def read_zipped_csv(spark: SparkSession, path: str, marker: str = "Delivery") -> DataFrame:
    """Archives of a folder or glob; every member is a partition of its own."""
    return _one_header(archive_lines(spark, path), marker)


def read_zipped_trades(spark: SparkSession, path: str) -> DataFrame:
    return _typed_trades(read_zipped_csv(spark, path))


def read_auction_wide(spark: SparkSession, path: str, combine_mode: str = "first") -> DataFrame:
    """Wide auction prices ('Hour 1' .. 'Hour 24', '3A'/'3B') as long rows."""
    raw = csv_below_banner(spark, path, "Hour")
    date_col = raw.columns[0]
    keep = [date_col] + [c for c in raw.columns[1:] if "hour" in c.lower()]
    d = raw.select(
        iso_day_first(F.col(f"`{date_col}`")).try_cast("date").alias("d"),
        *[F.col(f"`{c}`").try_cast("double").alias(c) for c in keep[1:]],
    ).filter(F.col("d").isNotNull())
    return unpivot_hours(d, "d", combine_mode)


def clean_curve_rows(df: DataFrame) -> DataFrame:
    """String curve rows (Date, Hour, Sale/Purchase, Price, Volume) -> typed rows:
    '3B' dropped, 'A' stripped, 1..24 -> 0..23, day-first dates."""
    hour = hour_of_label(F.col("Hour"))
    return df.select(
        iso_day_first(F.col("Date")).try_cast("date").alias("curve_date"),
        hour.alias("curve_hour"),
        F.col("`Sale/Purchase`").alias("side"),
        F.col("Price").try_cast("double").alias("price"),
        F.col("Volume").try_cast("double").alias("volume"),
    ).filter(F.col("curve_date").isNotNull() & F.col("curve_hour").isNotNull())


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".zip"):
        return clean_curve_rows(read_zipped_csv(spark, path, "Sale/Purchase"))
    return clean_curve_rows(csv_below_banner(spark, path, "Sale/Purchase"))


def clean_res_rows(
    df: DataFrame, time_col: str, value_col: str, kind: str, order: list[str], year: int | None = None
) -> DataFrame:
    """Forecast rows -> one per (date, hour): bracketed day-first times, the first of
    a doubled hour, and on spring change days hour 2 copied from hour 3."""
    bare = F.btrim(F.col(f"`{time_col}`"), F.lit("[] "))
    ts = iso_day_first(bare).try_cast("timestamp_ntz")
    name = f"{kind.lower()}_forecast"
    d = df.select(
        F.to_date(ts).alias("delivery_date"),
        F.hour(ts).alias("delivery_hour"),
        F.col(f"`{value_col}`").try_cast("double").alias(name),
        *order,
    ).filter(F.col("delivery_date").isNotNull())
    if year is not None:
        d = d.filter(F.year("delivery_date") == year)
    first = dedupe(d, ["delivery_date", "delivery_hour"], [F.col(c) for c in order]).drop(*order)
    keys = ["delivery_date", "delivery_hour"]
    lent = (
        first.filter((F.col("delivery_hour") == 3) & is_spring_change(F.col("delivery_date")))
        .withColumn("delivery_hour", F.lit(2))
        .join(first.select(*keys), keys, "left_anti")
    )
    return first.unionByName(lent)


def read_res_forecast(
    spark: SparkSession, path: str, kind: str, year: int | None = None
) -> DataFrame:
    """Wind or solar forecast file with a units row under the header."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_block_start").alias("_block_start"),
        F.monotonically_increasing_id().alias("_line"),
    )
    head = lines.filter(F.col("value").contains("Date")).select("value").head()
    if head is None:
        raise ValueError(f"cannot find a time column in {path}")
    raw = _parse_lines(lines, head["value"], ["_block_start", "_line"])
    times = [c for c in raw.columns if c == "Date (CET)"] or [c for c in raw.columns if "Date" in c]
    value = f"{kind.upper()} DA FORECAST (TENNET)"
    return clean_res_rows(raw, times[0], value, kind, ["_block_start", "_line"], year)


def flatten_contract_stats(df: DataFrame, json_col: str, zone: str = MARKET_ZONE) -> DataFrame:
    """Contract-statistics JSON -> one row per contract, local times."""
    c = df.select(F.explode(F.from_json(json_col, CONTRACT_STATS)["contracts"]).alias("c")).select("c.*")
    start, end = parse_instant(F.col("deliveryStart")), parse_instant(F.col("deliveryEnd"))

    def clock(ts, fmt):
        return F.date_format(to_local(ts, zone), fmt)

    return c.select(
        F.concat_ws(" - ", clock(start, "HH:mm"), clock(end, "HH:mm")).alias("delivery_period"),
        F.when(F.col("isLocalContract"), "Local").otherwise("SIDC").alias("market"),
        ((micros(end) - micros(start)) / 60_000_000).cast("int").alias("resolution_minutes"),
        F.col("highPrice").alias("high"),
        F.col("lowPrice").alias("low"),
        F.col("averagePrice").alias("vwap"),
        F.col("averagePriceLast3H").alias("vwap_3h"),
        F.col("averagePriceLast1H").alias("vwap_1h"),
        F.col("openPrice").alias("open"),
        F.col("closePrice").alias("close"),
        F.col("buyVolume").alias("buy_volume"),
        F.col("sellVolume").alias("sell_volume"),
        "volume",
        clock(parse_instant(F.col("contractOpenTime")), "yyyy-MM-dd HH:mm:ss").alias("open_time"),
        clock(parse_instant(F.col("contractCloseTime")), "yyyy-MM-dd HH:mm:ss").alias("close_time"),
    )


def flatten_area_volumes(
    df: DataFrame, json_col: str, areas: list[str], zone: str = MARKET_ZONE
) -> DataFrame:
    """Area-volume JSON (map area -> buy, sell) -> one wide row per delivery period.

    The areas are given, so each is a map lookup in the row: no pivot, no shuffle."""
    e = df.select(
        F.explode(F.from_json(json_col, AREA_VOLUMES)["multiAreaEntries"]).alias("e")
    ).select("e.*")
    start = parse_instant(F.col("deliveryStart"))
    end = parse_instant(F.col("deliveryEnd"))
    cols = []
    for a in areas:
        entry = F.try_element_at("entryPerArea", F.lit(a))
        cols += [entry["buy"].alias(f"{a} Buy (MW)"), entry["sell"].alias(f"{a} Sell (MW)")]
    return e.select(
        start.alias("delivery_start"),
        F.concat_ws(
            " - ",
            F.date_format(to_local(start, zone), "HH:mm"),
            F.date_format(to_local(end, zone), "HH:mm"),
        ).alias("delivery_period"),
        *cols,
    ).orderBy("delivery_start")


def file_date_range(df: DataFrame, name_col: str) -> DataFrame:
    """first_day and last_day from yyyyMMdd-yyyyMMdd in a file name; a name without
    one is an error."""
    found = F.regexp_extract(name_col, r"(\d{8})-(\d{8})", 0)
    checked = F.when(found != "", found).otherwise(
        F.raise_error(F.concat(F.lit("no date range in file name "), F.col(name_col))).cast("string")
    )
    return df.select(
        "*",
        F.to_date(F.substring(checked, 1, 8), "yyyyMMdd").alias("first_day"),
        F.to_date(F.substring(checked, 10, 8), "yyyyMMdd").alias("last_day"),
    )
