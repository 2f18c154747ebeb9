"""UTC calendar parts of a TIMESTAMP column.

``hour`` and ``to_date`` follow the session time zone. Event times are UTC by definition,
so these expressions work on the microseconds since 1970 and give the same answer in any
session.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, functions as F

# Display names.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

_HOUR_US = 3_600_000_000
DAY_US = 24 * _HOUR_US


def _floor_div(number: Column, width: int) -> Column:
    # A multiple of ``width`` divides without rounding, also as a double.
    return ((number - F.pmod(number, F.lit(width))) / F.lit(width)).cast("bigint")


def day_number(time: Column) -> Column:
    """Whole UTC days since 1970-01-01."""
    return _floor_div(F.unix_micros(time), DAY_US).cast("int")


def utc_date(time: Column) -> Column:
    return F.date_from_unix_date(day_number(time))


def hour_number(time: Column) -> Column:
    """Whole hours since 1970-01-01: one grouping key for every calendar unit."""
    return _floor_div(F.unix_micros(time), _HOUR_US)


def date_of_hour(number: Column) -> Column:
    return F.date_from_unix_date(_floor_div(number, 24).cast("int"))


def hour_of_hour(number: Column) -> Column:
    return F.pmod(number, F.lit(24).cast("bigint"))


def utc_hour(time: Column) -> Column:
    return hour_of_hour(hour_number(time))


def utc_month(time: Column) -> Column:
    return F.month(utc_date(time)).cast("bigint")


def weekday_of_date(date: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(date).cast("bigint")


def utc_weekday(time: Column) -> Column:
    return weekday_of_date(utc_date(time))


def weekday_name(weekday: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), weekday.cast("int") + 1)


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), month.cast("int"))


def parse_timestamp(text: Column) -> Column:
    """An RFC 3339 text with zone, 0 to 6 fraction digits; null if it is not one."""
    return F.try_to_timestamp(text)


def to_micros(moment: datetime) -> int:
    """Microseconds since 1970; a datetime without zone is read as UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def utc_literal(moment: datetime) -> Column:
    """A timestamp constant; folded by Catalyst, so comparisons with it reach the scan."""
    return F.timestamp_micros(F.lit(to_micros(moment)))


# Partition column of the stored event table.
DATE_COLUMN = "event_date"


def time_within(
    columns: list[str],
    at_least: Column | None = None,
    at_most: Column | None = None,
    after: Column | None = None,
    before: Column | None = None,
) -> Column:
    """Condition on ``time`` against constants.

    If ``columns`` has the partition date of the stored table, the condition limits it as
    well, so that other dates are not opened.
    """
    time, date = F.col("time"), F.col(DATE_COLUMN)
    limits = []
    for low, strict in ((at_least, False), (after, True)):
        if low is not None:
            limits.append(time > low if strict else time >= low)
            if DATE_COLUMN in columns:
                limits.append(date >= utc_date(low))
    for high, strict in ((at_most, False), (before, True)):
        if high is not None:
            limits.append(time < high if strict else time <= high)
            if DATE_COLUMN in columns:
                limits.append(date <= utc_date(high))
    return reduce(Column.__and__, limits)
