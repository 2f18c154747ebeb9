"""Mean, median, spread and limits of magnitude and depth, and table counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from temblor.operators.quantiles import medians_of

# Fixed value: assumed size of a stored event.
BYTES_PER_EVENT = 500


def medians(events: DataFrame, *columns: str) -> DataFrame:
    """(column, median): exact, the mean of the two middle values for an even count, null for none.

    Found by sketches and counts (``operators.quantiles``), whose scans run when this is called; what
    is left to read is one row for each column.
    """
    found = medians_of(events, *columns)
    return events.sparkSession.createDataFrame(
        [(c, found[c]) for c in columns], "column STRING, median DOUBLE")


def _long(events: DataFrame, *columns: str) -> DataFrame:
    """(column, value): one row for each of the columns."""
    return events.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns
    ])))


def column_stats(events: DataFrame, *columns: str, median: str = "exact") -> DataFrame:
    """(column, mean, median, std, min, max) of numeric columns that hold a value.

    All but the median are partial aggregates of the events. ``median="approx"`` takes
    ``approx_percentile`` with them and needs no further scan.
    """
    if median not in ("exact", "approx"):
        raise ValueError(f"unknown median {median!r}")
    near = F.approx_percentile("value", 0.5) if median == "approx" else F.lit(None).cast("double")
    moments = _long(events, *columns).filter(F.col("value").isNotNull()).groupBy("column").agg(
        F.avg("value").alias("mean"),
        near.alias("median"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    if median == "approx":
        return moments
    # One row for each column.
    exact = moments.drop("median").join(F.broadcast(medians(events, *columns)), "column", "left")
    return exact.select("column", "mean", "median", "std", "min", "max")


def stats_row(stats: DataFrame, column: str, suffix: str) -> DataFrame:
    """One row ``mean_<suffix>, median_<suffix>, ...`` of ``column_stats``; nulls if empty."""
    wanted = F.col("column") == column
    return stats.agg(
        *[
            F.max(F.when(wanted, F.col(name))).alias(f"{name}_{suffix}")
            for name in ("mean", "median", "std", "min", "max")
        ]
    )


def magnitude_stats(events: DataFrame, median: str = "exact") -> DataFrame:
    return stats_row(column_stats(events, "mag", median=median), "mag", "magnitude")


def depth_stats(events: DataFrame, median: str = "exact") -> DataFrame:
    return stats_row(column_stats(events, "depth", median=median), "depth", "depth")


def data_stats(events: DataFrame, version: str = "lastupdate") -> DataFrame:
    """Number of events, newest ``version`` time and the size estimate."""
    total = F.count("*")
    return events.agg(
        total.alias("total_events"),
        F.max(version).alias("last_updated"),
        (total * BYTES_PER_EVENT).alias("memory_usage_estimate"),
    )
