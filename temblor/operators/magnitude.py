"""Magnitude histogram, magnitude-frequency table and Gutenberg-Richter fits.

Everything starts from ``magnitude_counts``: at most about a hundred (mag_key, n) rows for
valid magnitudes, combined before the shuffle. The functions named ``..._of`` take such
counts, from one scan, from a summary table or from a stream alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from temblor.functions.magnitude import (
    bucket_label,
    ln_count,
    log10_cumulative,
    mag_bucket,
    mag_key,
    threshold_key,
)

# Completeness magnitude, least number of bins for a fit, result without a fit.
COMPLETENESS_MAGNITUDE = 2.0
LEAST_BINS = 3
DEFAULT_B = 1.0
DEFAULT_A = 0.0


def event_bins(events: DataFrame) -> DataFrame:
    """(mag_key, n) with one row per event: the counts of a table not counted yet."""
    known = events.filter(F.col("mag").isNotNull())
    return known.select(mag_key(F.col("mag")).alias("mag_key"), F.lit(1).alias("n"))


def magnitude_counts(events: DataFrame) -> DataFrame:
    """Events per tenth of a magnitude."""
    return event_bins(events).groupBy("mag_key").agg(F.count("*").alias("n"))


def distribution_of(counts: DataFrame) -> DataFrame:
    bars = counts.groupBy(mag_bucket(F.col("mag_key")).alias("bucket")).agg(
        F.sum("n").alias("count")
    )
    return bars.orderBy("bucket").select(bucket_label(F.col("bucket")).alias("magnitude"), "count")


def magnitude_distribution(events: DataFrame) -> DataFrame:
    """Histogram with bars of 0.2, in numeric order."""
    return distribution_of(event_bins(events))


def cumulative_of(counts: DataFrame) -> DataFrame:
    """Adds the number of events at or above each bin.

    The window has no partition key; it runs over the bins, not over events.
    """
    from_top = Window.orderBy(F.desc("mag_key")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return counts.withColumn("cumulative", F.sum("n").over(from_top))


def frequency_of(counts: DataFrame) -> DataFrame:
    return (
        cumulative_of(counts)
        .orderBy("mag_key")
        .select(
            (F.col("mag_key") / 10.0).alias("magnitude"), F.col("n").alias("count"), "cumulative"
        )
    )


def magnitude_frequency(events: DataFrame) -> DataFrame:
    """Bin magnitude, count and count at or above it, ascending."""
    return frequency_of(magnitude_counts(events))


def _fit_points(counts: DataFrame, completeness: float) -> DataFrame:
    return counts.filter((F.col("mag_key") >= threshold_key(completeness)) & (F.col("n") > 0))


def fit_of(counts: DataFrame, completeness: float = COMPLETENESS_MAGNITUDE) -> DataFrame:
    """One row (b_value, a_value, completeness_magnitude) by the established rule.

    It regresses ln(bin count) on magnitude and reports the slope as ``b_value`` and
    mean(ln n) + slope * mean(m) as ``a_value``. For a physical b-value use
    ``published_fit_of``. Fewer than three usable bins give the defaults.
    """
    m = F.col("mag_key") / 10.0
    points = _fit_points(counts, completeness).select(m.alias("m"), ln_count(F.col("n")).alias("l"))
    slope = F.regr_slope("l", "m")
    enough = F.count("*") >= LEAST_BINS
    return points.agg(
        F.when(enough, slope).otherwise(DEFAULT_B).alias("b_value"),
        F.when(enough, F.avg("l") + slope * F.avg("m")).otherwise(DEFAULT_A).alias("a_value"),
    ).withColumn("completeness_magnitude", F.lit(completeness))


def gr_fit(events: DataFrame, completeness: float = COMPLETENESS_MAGNITUDE) -> DataFrame:
    return fit_of(magnitude_counts(events), completeness)


def published_fit_of(counts: DataFrame, completeness: float = COMPLETENESS_MAGNITUDE) -> DataFrame:
    """One row (b_value, a_value, completeness_magnitude) of log10 N(>=M) = a - b M."""
    points = cumulative_of(_fit_points(counts, completeness)).select(
        (F.col("mag_key") / 10.0).alias("m"),
        log10_cumulative(F.col("cumulative")).alias("l"),
    )
    enough = F.count("*") >= LEAST_BINS
    return points.agg(
        F.when(enough, -F.regr_slope("l", "m")).otherwise(DEFAULT_B).alias("b_value"),
        F.when(enough, F.regr_intercept("l", "m")).otherwise(DEFAULT_A).alias("a_value"),
    ).withColumn("completeness_magnitude", F.lit(completeness))


def gr_fit_published(events: DataFrame, completeness: float = COMPLETENESS_MAGNITUDE) -> DataFrame:
    return published_fit_of(magnitude_counts(events), completeness)


def b_value(events: DataFrame) -> DataFrame:
    return gr_fit(events).select("b_value")


def a_value(events: DataFrame) -> DataFrame:
    return gr_fit(events).select("a_value")


def completeness_magnitude(events: DataFrame) -> DataFrame:
    return gr_fit(events).select("completeness_magnitude")


def gr_section_of(counts: DataFrame, completeness: float = COMPLETENESS_MAGNITUDE) -> DataFrame:
    """The fit and the number of events with a magnitude, in one pass over the bins."""
    m = F.when(F.col("mag_key") >= threshold_key(completeness), F.col("mag_key") / 10.0)
    log_n = ln_count(F.col("n"))
    points = counts.select("n", m.alias("m"), F.when(m.isNotNull(), log_n).alias("l"))
    slope = F.regr_slope("l", "m")
    enough = F.count("m") >= LEAST_BINS
    return points.agg(
        F.when(enough, slope).otherwise(DEFAULT_B).alias("b_value"),
        F.when(enough, F.avg("l") + slope * F.avg("m")).otherwise(DEFAULT_A).alias("a_value"),
        F.lit(completeness).alias("completeness_magnitude"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
    )


def gr_section(events: DataFrame) -> DataFrame:
    return gr_section_of(magnitude_counts(events))
