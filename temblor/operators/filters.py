"""Row filters and projections on the event table."""

from __future__ import annotations

from datetime import datetime
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from temblor.functions.calendar import time_within, utc_date, utc_hour, utc_literal, utc_month

# Fixed value: the map shows clusters nearer to the equator than this.
MAP_LATITUDE = 70


def events_in_range(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    inside = time_within(events.columns, at_least=utc_literal(start), at_most=utc_literal(end))
    return events.filter(inside)


def events_in_bbox(
    events: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float
) -> DataFrame:
    """Inclusive box; it does not cross the 180 degree line."""
    return events.filter(
        F.col("lat").between(min_lat, max_lat) & F.col("lon").between(min_lon, max_lon)
    )


def events_above_magnitude(events: DataFrame, min_magnitude: float) -> DataFrame:
    return events.filter(F.col("mag") >= min_magnitude)


def mag_depth_pairs(events: DataFrame) -> DataFrame:
    """Magnitude and depth where both are known; unordered."""
    known = F.col("mag").isNotNull() & F.col("depth").isNotNull()
    return events.filter(known).select("mag", "depth")


def map_clusters(clusters: DataFrame) -> DataFrame:
    """Grid clusters that the map shows."""
    return clusters.filter(F.abs("lat") < MAP_LATITUDE)


def add_time_parts(events: DataFrame) -> DataFrame:
    time = F.col("time")
    return events.withColumns(
        {"date": utc_date(time), "hour": utc_hour(time), "month": utc_month(time)}
    )


def tag_section(section: DataFrame, title: str) -> DataFrame:
    """Mark every row with its section title; ``drop("title")`` takes it off again."""
    return section.withColumn("title", F.lit(title))


def map_events(
    events: DataFrame,
    function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Run a Python function over all events in Arrow batches.

    For row code that has no Column form; ``DataFrame.transform`` is the way otherwise.
    """
    return events.mapInPandas(function, schema)


def event_frame(events: DataFrame, view: str | None = None) -> DataFrame:
    """The table itself, also as a temporary view for SQL when a name is given."""
    if view:
        events.createOrReplaceTempView(view)
    return events


