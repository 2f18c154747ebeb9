"""Exceedance probabilities and energy release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from temblor.functions.calendar import DAY_US
from temblor.functions.magnitude import mag_key, magnitude_to_energy, threshold_key
from temblor.functions.risk import (
    energy_tnt_scaled,
    energy_tnt_tons,
    poisson_exceedance,
    risk_level,
    risk_sentence,
)

# Magnitude threshold and horizon in days of the three standard metrics.
STANDARD_RISKS = {
    "prob_mag5_30days": (5.0, 30.0),
    "prob_mag6_365days": (6.0, 365.0),
    "prob_mag7_365days": (7.0, 365.0),
}


def _timed(events: DataFrame) -> DataFrame:
    return events.filter(F.col("mag").isNotNull() & F.col("time").isNotNull())


def count_at_least(threshold: float) -> Column:
    """Aggregate: events whose bin is at or above the bin of ``threshold``."""
    return F.count_if(mag_key(F.col("mag")) >= threshold_key(threshold))


def span_days(first: Column, last: Column) -> Column:
    """Days between two times; 1 if they do not differ or there are none."""
    days = (F.unix_micros(last) - F.unix_micros(first)) / float(DAY_US)
    return F.when(days > 0, days).otherwise(1.0)


def events_at_least(events: DataFrame, threshold: float) -> DataFrame:
    return _timed(events).agg(count_at_least(threshold).alias("count"))


def time_span_days(events: DataFrame) -> DataFrame:
    return _timed(events).agg(
        span_days(F.min("time"), F.max("time")).alias("time_span_days")
    )


def exceedance_probability(events: DataFrame, threshold: float, days: float) -> DataFrame:
    """Chance of an event at or above ``threshold`` within ``days``."""
    expected = count_at_least(threshold) / span_days(F.min("time"), F.max("time")) * days
    return _timed(events).agg(poisson_exceedance(expected).alias("probability"))


def total_energy(events: DataFrame) -> DataFrame:
    energy = F.sum(magnitude_to_energy(F.col("mag")))
    return _timed(events).agg(F.coalesce(energy, F.lit(0.0)).alias("total_energy"))


def risk_inputs(events: DataFrame) -> DataFrame:
    """One row: counts per standard threshold, time limits, energy and event count."""
    timed = F.col("time").isNotNull() & F.col("mag").isNotNull()
    when_timed = F.when(timed, F.col("time"))
    key = mag_key(F.col("mag"))
    counts = [
        F.count_if(timed & (key >= threshold_key(threshold))).alias(f"n_{name}")
        for name, (threshold, _) in STANDARD_RISKS.items()
    ]
    return events.agg(
        *counts,
        F.min(when_timed).alias("first_time"),
        F.max(when_timed).alias("last_time"),
        F.sum(F.when(timed, magnitude_to_energy(F.col("mag")))).alias("energy"),
        F.count("mag").alias("total_events"),
    )


def risk_section_of(inputs: DataFrame) -> DataFrame:
    """The standard metrics from one row of ``risk_inputs``."""
    span = span_days(F.col("first_time"), F.col("last_time"))
    chances = [
        poisson_exceedance(F.col(f"n_{name}") / span * days).alias(name)
        for name, (_, days) in STANDARD_RISKS.items()
    ]
    return inputs.select(
        *chances,
        F.coalesce("energy", F.lit(0.0)).alias("total_energy_joules"),
        "total_events",
    )


def risk_metrics(events: DataFrame) -> DataFrame:
    """The three probabilities and the energy, from one scan."""
    return risk_section_of(risk_inputs(events)).drop("total_events")


def risk_section(events: DataFrame) -> DataFrame:
    return risk_section_of(risk_inputs(events))


def risk_reading(events: DataFrame) -> DataFrame:
    """Risk level and its sentence, from the chance of M6 within a year."""
    chance = exceedance_probability(events, *STANDARD_RISKS["prob_mag6_365days"])
    level = risk_level(F.col("probability"))
    return chance.select(
        "probability", level.alias("risk_level"), risk_sentence(level).alias("sentence")
    )


def energy_in_tnt(events: DataFrame) -> DataFrame:
    energy = F.col("total_energy")
    return total_energy(events).select(
        "total_energy",
        energy_tnt_tons(energy).alias("tnt_tons"),
        energy_tnt_scaled(energy).alias("tnt_scaled"),
    )
