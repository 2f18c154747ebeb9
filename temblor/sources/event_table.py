"""The stored event table: Parquet, partitioned by UTC date, files ordered by time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from temblor.functions.calendar import DATE_COLUMN, time_within, utc_date, utc_literal
from temblor.functions.geo import place_key
from temblor.schema import EVENT_COLUMNS, EVENT_SCHEMA
from temblor.sources.geojson import empty_events

_STORED_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField(DATE_COLUMN, T.DateType())])


def write_events(events: DataFrame, path: str, clear: bool = False, layout: str = "time") -> None:
    """Append to the table, or replace all of it when ``clear`` is set.

    With layout ``time`` the rebalance hint gathers each date into few files. Adaptive execution
    splits a date that is too big for one task and merges small ones, so a busy day does not become
    one slow task. Sorting inside the task lets readers skip row groups by time.

    With layout ``place`` the rows of a date lie along a curve through the cells of the globe, dealt
    out by ranges of it. A box or a circle then touches few files, row groups and pages of each date,
    as its limits of latitude and longitude reach the scan.
    """
    dated = events.select(*EVENT_COLUMNS).withColumn(DATE_COLUMN, utc_date(F.col("time")))
    if layout == "time":
        placed = dated.hint("rebalance", DATE_COLUMN).sortWithinPartitions(DATE_COLUMN, "time")
    elif layout == "place":
        where = place_key(F.col("lat"), F.col("lon"))
        placed = dated.repartitionByRange(DATE_COLUMN, where).sortWithinPartitions(DATE_COLUMN, where, "time")
    else:
        raise ValueError(f"unknown layout {layout!r}")
    (
        placed.write.mode("overwrite" if clear else "append")
        .option("partitionOverwriteMode", "static")
        .partitionBy(DATE_COLUMN)
        .parquet(path)
    )


def clear_events(spark: SparkSession, path: str) -> None:
    """Leave an empty table."""
    empty_events(spark).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(path)


def read_events(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    with_date: bool = False,
) -> DataFrame:
    """The table, or the part with ``start <= time <= end``; other dates are not opened.

    ``with_date`` keeps ``event_date`` beside the 13 columns. Filters on time, retention,
    time-ordered pages and queries then skip whole dates on their own.
    """
    stored = spark.read.schema(_STORED_SCHEMA).parquet(path)
    if start is not None:
        stored = stored.filter(time_within(stored.columns, at_least=utc_literal(start)))
    if end is not None:
        stored = stored.filter(time_within(stored.columns, at_most=utc_literal(end)))
    return stored if with_date else stored.select(*EVENT_COLUMNS)


def append_events(events: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of two event frames without any check for repeats."""
    return events.unionByName(incoming)
