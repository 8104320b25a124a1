"""Clock arithmetic on TIMESTAMP_NTZ columns.

Wall-clock times and instants are both kept as TIMESTAMP_NTZ (instants in UTC),
and zones are always named, so no result depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "Europe/Amsterdam"


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 on the column's own clock."""
    whole = (
        F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000
        + F.hour(ts).cast("long") * 3_600_000_000
        + F.minute(ts).cast("long") * 60_000_000
    )
    # Below one minute a double holds microseconds exactly.
    return whole + (F.extract(F.lit("SECOND"), ts).cast("double") * 1e6 + 0.5).cast("long")


def minutes_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(60_000_000.0)


def shift_minutes(ts: Column, minutes: Column | int) -> Column:
    minutes = F.lit(minutes) if isinstance(minutes, int) else minutes
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def at_hour(day: Column, hour: Column | int) -> Column:
    """Wall-clock timestamp of an hour of a day (hour 24 is the next midnight)."""
    hour = F.lit(hour) if isinstance(hour, int) else hour
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour.cast("int"))


def trunc_hour(ts: Column) -> Column:
    return at_hour(F.to_date(ts), F.hour(ts))


def parse_instant(text: Column) -> Column:
    """ISO-8601 text with Z or a numeric offset -> UTC instant; bad text -> null."""
    offset = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$", 0)
    sign = F.when(offset.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_replace(offset, r"[+\-:]", "")
    minutes = F.when(offset == "", F.lit(0)).otherwise(
        sign
        * (
            F.substring(digits, 1, 2).try_cast("int") * 60
            + F.substring(digits, 3, 2).try_cast("int")
        )
    )
    bare = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return shift_minutes(bare.try_cast("timestamp_ntz"), -minutes)


def iso_day_first(text: Column) -> Column:
    """'31/10/2021 02:00' -> '2021-10-31 02:00', ready for a cast that knows no zone."""
    return F.regexp_replace(F.btrim(text), r"^(\d{1,2})/(\d{1,2})/(\d{4})(.*)$", "$3-$2-$1$4")


def to_local(instant: Column, zone: str = MARKET_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant)


def to_instant(wall: Column, zone: str = MARKET_ZONE) -> Column:
    """Wall clock -> UTC instant. A skipped hour moves forward by the gap and a
    repeated hour means its first occurrence."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def effective_start(day: Column, hour: Column, zone: str = MARKET_ZONE) -> Column:
    """Instant at which the contract of (day, hour) is delivered."""
    return to_instant(at_hour(day, hour), zone)


def day_seconds(day: Column, zone: str = MARKET_ZONE) -> Column:
    start = micros(to_instant(at_hour(day, 0), zone))
    end = micros(to_instant(at_hour(day, 24), zone))
    return ((end - start) / 1_000_000).cast("long")


def is_clock_change(day: Column, zone: str = MARKET_ZONE) -> Column:
    return day_seconds(day, zone) != 86400


def is_spring_change(day: Column, zone: str = MARKET_ZONE) -> Column:
    return day_seconds(day, zone) < 86400


def is_autumn_change(day: Column, zone: str = MARKET_ZONE) -> Column:
    return day_seconds(day, zone) > 86400


def bin_axis(start_wall: Column, start_hours: int, minutes: int) -> Column:
    """Array of wall-clock bin starts of the last start_hours before delivery."""
    n = start_hours * 60 // minutes
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: shift_minutes(start_wall, k * minutes - start_hours * 60),
    )


def shift_hour(day: Column, hour: Column, offset: Column | int) -> tuple[Column, Column]:
    """(day, hour) moved by whole hours across midnight."""
    total = hour + offset
    return F.date_add(day, F.floor(total / 24).cast("int")), F.pmod(total, F.lit(24)).cast("int")


def weekday_flags(day: Column) -> dict[str, Column]:
    return {
        name: (F.weekday(day) == number).cast("int")
        for name, number in {"MON": 0, "SAT": 5, "SUN": 6}.items()
    }
