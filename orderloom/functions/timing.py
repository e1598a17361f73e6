"""Times: nanoseconds since the epoch in BIGINT columns, bins, dates and session bounds."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000_000
DAY = 86_400 * SECOND


def as_date(value: str | dt.date) -> dt.date:
    """A date, YYYY-MM-DD or YYYYMMDD."""
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(value if "-" in value else f"{value[:4]}-{value[4:6]}-{value[6:8]}")


def day_ns(value: str | dt.date) -> int:
    """Nanoseconds of a UTC day's start."""
    return (as_date(value) - dt.date(1970, 1, 1)).days * DAY


def whole(a: Column, b: int) -> Column:
    """Integral division: nanoseconds don't fit a double."""
    return F.call_function("div", a, F.lit(b))


def utc_ts(ns: Column) -> Column:
    return F.timestamp_micros(whole(ns, 1000))


def local_ts(ns: Column, tz: str) -> Column:
    """Wall-clock time in a zone, for display and grouping."""
    return F.from_utc_timestamp(utc_ts(ns), tz)


def with_datetime(df: DataFrame, column: str = "ts_recv", new: str | None = None) -> DataFrame:
    return df.withColumn(new or f"{column}_dt", utc_ts(F.col(column)))


def utc_date(ns: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), ((ns - F.pmod(ns, F.lit(DAY))) / DAY).cast("int"))


def second_of_day(ns: Column) -> Column:
    return (F.pmod(ns, F.lit(DAY)) / SECOND).cast("long")


def clock(seconds: Column) -> Column:
    """HH:mm:ss of a second of the day."""
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))


def time_bin(ns: Column, minutes: int) -> Column:
    """The UTC bin of a time as HH:mm:ss; bins start at midnight, so widths divide a day."""
    if minutes < 1 or 1440 % minutes:
        raise ValueError("bin_minutes must divide a day")
    seconds = second_of_day(ns)
    return clock(seconds - seconds % (60 * minutes))


def iso_weekday(ns: Column) -> Column:
    """1 for Monday to 7; the epoch was a Thursday."""
    return (F.pmod((ns - F.pmod(ns, F.lit(DAY))) / DAY + 3, F.lit(7)) + 1).cast("int")


def seconds(text: str) -> int:
    h, m, s = map(int, text.split(":"))
    return 3600 * h + 60 * m + s


def us_summer(day: dt.date) -> bool:
    """Whether New York keeps daylight-saving time at noon of a day."""
    noon = dt.datetime.combine(day, dt.time(12), ZoneInfo("America/New_York"))
    return bool(noon.dst())
