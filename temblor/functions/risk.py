"""Probability, risk wording and energy units as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Limits and wording of the two readings, and the energy units.
LOW_B_VALUE = 0.8
HIGH_B_VALUE = 1.2
HIGH_STRESS = "High stress environment - more large earthquakes expected"
LOW_STRESS = "Low stress environment - small earthquakes dominate"
NORMAL_STRESS = "Normal stress environment - typical earthquake distribution"

HIGH_RISK = 0.1
MODERATE_RISK = 0.05
RISK_SENTENCES = {
    "High": "Increased likelihood of significant earthquakes",
    "Moderate": "Potential for moderate earthquakes",
    "Low": "Low likelihood of significant earthquakes",
}

ENERGY_PER_TNT_TON = 4.184e9
TNT_SCALE = 1e12


def poisson_exceedance(expected: Column) -> Column:
    """Chance of at least one event when ``expected`` events are due."""
    return -F.expm1(-expected)


def b_value_interpretation(b_value: Column) -> Column:
    return (
        F.when(b_value < LOW_B_VALUE, HIGH_STRESS)
        .when(b_value > HIGH_B_VALUE, LOW_STRESS)
        .otherwise(NORMAL_STRESS)
    )


def risk_level(probability: Column) -> Column:
    return (
        F.when(probability > HIGH_RISK, "High")
        .when(probability > MODERATE_RISK, "Moderate")
        .otherwise("Low")
    )


def risk_sentence(level: Column) -> Column:
    return (
        F.when(level == "High", RISK_SENTENCES["High"])
        .when(level == "Moderate", RISK_SENTENCES["Moderate"])
        .otherwise(RISK_SENTENCES["Low"])
    )


def energy_tnt_tons(energy: Column) -> Column:
    return energy / F.lit(ENERGY_PER_TNT_TON)


def energy_tnt_scaled(energy: Column) -> Column:
    return energy_tnt_tons(energy) / F.lit(TNT_SCALE)
