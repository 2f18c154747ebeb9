"""Activity per day, hour, month and weekday (UTC).

The ``..._of`` functions take (date, hour, n): events with n = 1, or counts from a summary
table or a stream. Either way there is one grouping, combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from temblor.functions.calendar import (
    WEEKDAYS,
    date_of_hour,
    hour_number,
    hour_of_hour,
    month_name,
    weekday_name,
    weekday_of_date,
)


def event_hours(events: DataFrame) -> DataFrame:
    """(date, hour, n) with one row per event: the counts of a table not counted yet."""
    return dated(events.select(hour_number(F.col("time")).alias("hour_number"), F.lit(1).alias("n")))


def dated(counts: DataFrame) -> DataFrame:
    """(hour_number, n) as (date, hour, n); events without a time have nulls."""
    number = F.col("hour_number")
    return counts.select(
        date_of_hour(number).alias("date"), hour_of_hour(number).alias("hour"), "n"
    )


def _known(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("date").isNotNull())


def daily_of(counts: DataFrame) -> DataFrame:
    return _known(counts).groupBy("date").agg(F.sum("n").alias("count")).orderBy("date")


def hourly_of(counts: DataFrame) -> DataFrame:
    return _known(counts).groupBy("hour").agg(F.sum("n").alias("count")).orderBy("hour")


def monthly_of(counts: DataFrame) -> DataFrame:
    month = F.month("date").cast("bigint").alias("month")
    return _known(counts).groupBy(month).agg(F.sum("n").alias("count")).orderBy("month")


def weekly_of(counts: DataFrame) -> DataFrame:
    """Always seven rows, Monday first."""
    weekday = weekday_of_date(F.col("date"))
    seen = _known(counts).groupBy(weekday.alias("weekday")).agg(F.sum("n").alias("count"))
    return fill_weekdays(seen)


def fill_weekdays(seen: DataFrame) -> DataFrame:
    """Left join of (weekday, count) to the seven weekdays; missing days count 0.

    Both sides have at most seven rows.
    """
    spine = seen.sparkSession.range(len(WEEKDAYS)).select(
        F.col("id").alias("weekday"), weekday_name(F.col("id")).alias("name")
    )
    return (
        spine.join(F.broadcast(seen), "weekday", "left")
        .orderBy("weekday")
        .select(F.col("name").alias("weekday"), F.coalesce("count", F.lit(0)).alias("count"))
    )


def daily_counts(events: DataFrame) -> DataFrame:
    return daily_of(event_hours(events))


def hourly_frequency(events: DataFrame) -> DataFrame:
    """Hours that occur, 0 to 23."""
    return hourly_of(event_hours(events))


def monthly_frequency(events: DataFrame) -> DataFrame:
    """Months that occur, 1 to 12, years merged."""
    return monthly_of(event_hours(events))


def weekly_frequency(events: DataFrame) -> DataFrame:
    return weekly_of(event_hours(events))


def with_month_names(monthly: DataFrame) -> DataFrame:
    return monthly.select(month_name(F.col("month")).alias("month_name"), "month", "count")


def temporal_section_of(counts: DataFrame) -> DataFrame:
    """Events per date in date order; events without a time form one row."""
    return counts.groupBy("date").agg(F.sum("n").alias("daily_count")).orderBy("date")


def temporal_section(events: DataFrame) -> DataFrame:
    return temporal_section_of(event_hours(events))
