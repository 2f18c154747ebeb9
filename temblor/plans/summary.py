"""Results read from a summary table instead of the events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from temblor.operators import geo, magnitude, risk, stats, temporal
from temblor.functions.magnitude import threshold_key
from temblor.plans.processors import (
    CALENDAR,
    GRID,
    MAGNITUDE,
    MEASURES,
    PROCESSORS,
    QUANTILES,
    REGION,
    WHOLE,
    Measure,
    Processor,
    merge_summaries,
    part,
    summarize,
)


def recompute_all(
    events: DataFrame, path: str,
    processors: tuple[Processor, ...] = PROCESSORS, measures: Mapping[str, Measure] = MEASURES,
) -> None:
    """Rebuild the summary of all events from the table, in one pass."""
    summarize(events, processors, measures).hint("rebalance").write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(path)


def read_summary(
    spark: SparkSession, path: str,
    processors: tuple[Processor, ...] = PROCESSORS, measures: Mapping[str, Measure] = MEASURES,
) -> DataFrame:
    """The merged summary of a rebuilt or a streamed summary table."""
    return merge_summaries(spark.read.parquet(path), processors, measures)


def magnitude_counts(summary: DataFrame) -> DataFrame:
    return part(summary, MAGNITUDE).filter(F.col("mag_key").isNotNull()).select("mag_key", "n")


def calendar_counts(summary: DataFrame) -> DataFrame:
    return temporal.dated(part(summary, CALENDAR))


def magnitude_distribution(summary: DataFrame) -> DataFrame:
    return magnitude.distribution_of(magnitude_counts(summary))


def magnitude_frequency(summary: DataFrame) -> DataFrame:
    return magnitude.frequency_of(magnitude_counts(summary))


def gr_section(summary: DataFrame) -> DataFrame:
    return magnitude.gr_section_of(magnitude_counts(summary))


def daily_counts(summary: DataFrame) -> DataFrame:
    return temporal.daily_of(calendar_counts(summary))


def hourly_frequency(summary: DataFrame) -> DataFrame:
    return temporal.hourly_of(calendar_counts(summary))


def monthly_frequency(summary: DataFrame) -> DataFrame:
    return temporal.monthly_of(calendar_counts(summary))


def weekly_frequency(summary: DataFrame) -> DataFrame:
    return temporal.weekly_of(calendar_counts(summary))


def temporal_section(summary: DataFrame) -> DataFrame:
    return temporal.temporal_section_of(calendar_counts(summary))


def region_stats(summary: DataFrame) -> DataFrame:
    return part(summary, REGION).select(
        "flynn_region",
        F.col("n").alias("event_count"),
        F.try_divide("sum_mag", "n_mag").alias("avg_magnitude"),
        F.try_divide("sum_depth", "n_depth").alias("avg_depth"),
    )


def region_hotspots(summary: DataFrame) -> DataFrame:
    counts = part(summary, REGION).select("flynn_region", F.col("n_located").alias("count"))
    return counts.filter(F.col("flynn_region").isNotNull() & (F.col("count") > 0)).orderBy(
        F.desc("count"), "flynn_region"
    )


def coordinate_clusters(summary: DataFrame) -> DataFrame:
    cells = part(summary, GRID).select("lat_key", "lon_key", F.col("n_located").alias("count"))
    return geo.cells_of(cells.filter(F.col("count") > 0))


def risk_section(summary: DataFrame) -> DataFrame:
    """From the magnitude bins: counts, energy and time limits add up over them."""
    counts = [
        F.coalesce(
            F.sum(F.when(F.col("mag_key") >= threshold_key(threshold), F.col("n_timed"))), F.lit(0)
        ).alias(f"n_{name}")
        for name, (threshold, _) in risk.STANDARD_RISKS.items()
    ]
    inputs = part(summary, MAGNITUDE).agg(
        *counts,
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.sum("energy").alias("energy"),
        F.coalesce(F.sum("n_mag"), F.lit(0)).alias("total_events"),
    )
    return risk.risk_section_of(inputs)


def data_stats(summary: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("n"), F.lit(0))
    return part(summary, MAGNITUDE).agg(
        total.alias("total_events"),
        F.max("last_update").alias("last_updated"),
        (total * stats.BYTES_PER_EVENT).alias("memory_usage_estimate"),
    )


def running_medians(summary: DataFrame) -> DataFrame:
    """(median_magnitude, median_depth) from a summary of ``QUANTILES``: within the sketch's error of
    about one percent of the ranks, exact for a few hundred values; null without any."""
    def median(name: str) -> Column:
        return F.when(F.kll_sketch_get_n_double(name) > 0, F.kll_sketch_get_quantile_double(name, F.lit(0.5)))

    whole = part(summary, WHOLE, QUANTILES)
    return whole.select(median("mag_values").alias("median_magnitude"), median("depth_values").alias("median_depth"))
