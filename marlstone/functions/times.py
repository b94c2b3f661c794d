"""Calendar parts, local times and epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(ts: Column) -> list[Column]:
    """year, month, day, time (as text) and date of a timestamp."""
    return [
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.date_format(ts, "HH:mm:ss").alias("time"),
        F.to_date(ts).alias("date"),
    ]


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def week_of(day: Column) -> Column:
    """The Monday of a date's week."""
    return F.trunc(day, "week")


def local_time(ts: Column, timezone: Column) -> Column:
    return F.from_utc_timestamp(ts, timezone)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)
