"""Regions and half-degree grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from temblor.functions.geo import half_degree_key

# Fixed value: length of the region lists.
TOP_REGIONS = 10
OTHERS = "Others"


def _located(events: DataFrame) -> DataFrame:
    return events.filter(
        F.col("flynn_region").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )


def region_hotspots(events: DataFrame) -> DataFrame:
    """Events per region, busiest first; equal counts by name."""
    counts = _located(events).groupBy("flynn_region").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "flynn_region")


def coordinate_clusters(events: DataFrame) -> DataFrame:
    """Events per half-degree cell. Cells at 180 and -180 degrees stay apart."""
    cells = (
        _located(events)
        .groupBy(
            half_degree_key(F.col("lat")).alias("lat_key"),
            half_degree_key(F.col("lon")).alias("lon_key"),
        )
        .agg(F.count("*").alias("count"))
    )
    return cells_of(cells)


def cells_of(cells: DataFrame) -> DataFrame:
    """(lat_key, lon_key, count) as cell centres in degrees."""
    return cells.select(
        (F.col("lat_key") / 2.0).alias("lat"), (F.col("lon_key") / 2.0).alias("lon"), "count"
    )


def region_stats(events: DataFrame) -> DataFrame:
    """Count and mean magnitude and depth per region; a null region is a region."""
    return events.groupBy("flynn_region").agg(
        F.count("*").alias("event_count"),
        F.avg("mag").alias("avg_magnitude"),
        F.avg("depth").alias("avg_depth"),
    )


def top_regions(stats: DataFrame, n: int = TOP_REGIONS) -> DataFrame:
    """The busiest regions of a table with ``event_count``; equal counts by name."""
    return stats.orderBy(F.desc("event_count"), "flynn_region").limit(n)


def hotspot_section(events: DataFrame) -> DataFrame:
    return top_regions(region_stats(events)).select("flynn_region", "event_count", "avg_magnitude")


def regional_analysis(events: DataFrame) -> DataFrame:
    return top_regions(region_stats(events))


def region_rank(events: DataFrame) -> DataFrame:
    """The busiest regions with their rank; the window sees only the listed rows."""
    order = Window.orderBy(F.desc("event_count"), "flynn_region")
    listed = top_regions(
        events.filter(F.col("flynn_region").isNotNull())
        .groupBy("flynn_region")
        .agg(F.count("*").alias("event_count"))
    )
    return listed.withColumn("rank", F.row_number().over(order).cast("bigint"))


def region_pie(events: DataFrame) -> DataFrame:
    """The ten busiest regions and one row for all others, if there are any.

    The ten are found first and joined back, so no task ranks the full list of regions.
    """
    counts = (
        events.filter(F.col("flynn_region").isNotNull())
        .groupBy("flynn_region")
        .agg(F.count("*").alias("event_count"))
    )
    top = top_regions(counts).select("flynn_region", F.lit(True).alias("listed"))
    label = F.when(F.col("listed"), F.col("flynn_region")).otherwise(OTHERS)
    return (
        counts.join(F.broadcast(top), "flynn_region", "left")
        .groupBy(F.coalesce("listed", F.lit(False)).alias("listed"), label.alias("name"))
        .agg(F.sum("event_count").alias("value"))
        .orderBy(F.desc("listed"), F.desc("value"), "name")
        .select("name", "value")
    )
