"""Column expressions over dates. Every metric takes ``as_of`` instead of reading a clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = datetime | str


def at(as_of: AsOf) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def months_before(as_of: AsOf | Column, months: int) -> Column:
    """Calendar months back, clamped to the month end, time of day kept."""
    point = as_of if isinstance(as_of, Column) else at(as_of)
    return point - F.make_ym_interval(F.lit(0), F.lit(months))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole 24-hour days, truncated toward zero."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    days = micros / F.lit(86_400_000_000)
    return F.when(days < 0, F.ceil(days)).otherwise(F.floor(days)).cast("bigint")


def format_day(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "MMM d, yyyy"), F.lit("Never"))


def to_db_date(c: Column) -> Column:
    """MM/DD/YYYY text to yyyy-MM-dd text."""
    return F.date_format(F.try_to_timestamp(c, F.lit("MM/dd/yyyy")), "yyyy-MM-dd")


def to_db_time(c: Column) -> Column:
    """``1:05 PM`` or ``13:05`` to ``13:05:00``."""
    text = F.upper(F.trim(c))
    parsed = F.coalesce(
        F.try_to_timestamp(text, F.lit("h:mm a")), F.try_to_timestamp(text, F.lit("H:mm"))
    )
    return F.date_format(parsed, "HH:mm:ss")


def split_event_timestamp(c: Column) -> Column:
    """Struct(date, time) of a timestamp, as text."""
    return F.struct(
        F.date_format(c, "yyyy-MM-dd").alias("date"), F.date_format(c, "HH:mm:ss").alias("time")
    )
