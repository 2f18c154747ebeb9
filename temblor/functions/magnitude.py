"""Magnitude bins, labels and energy as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bin limits and the energy relation log10(E) = 11.8 + 1.5 M.
MAX_KEY = 4294967295
ENERGY_OFFSET = 11.8
ENERGY_SLOPE = 1.5


def mag_key(mag: Column) -> Column:
    """Tenths of a magnitude, cut towards zero and held in 0..2^32-1; NaN counts as 0."""
    held = F.least(F.greatest(mag * 10, F.lit(0.0)), F.lit(float(MAX_KEY)))
    return F.when(F.isnan(mag), F.lit(0).cast("bigint")).when(
        mag.isNotNull(), held.cast("bigint")
    )


def threshold_key(threshold: float) -> int:
    """``mag_key`` of a plain number."""
    return min(max(int(threshold * 10), 0), MAX_KEY)


def mag_bucket(key: Column) -> Column:
    """The even key at or below ``key``: histogram bars are 0.2 wide."""
    return key - key % 2


def bucket_label(bucket: Column) -> Column:
    """Bar start as text without a trailing ``.0`` ("2", "2.2")."""
    return F.regexp_replace((bucket / F.lit(10.0)).cast("string"), r"\.0$", "")


def magnitude_to_energy(mag: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(ENERGY_OFFSET) + F.lit(ENERGY_SLOPE) * mag)


def ln_count(n: Column) -> Column:
    return F.ln(n)


def log10_cumulative(n: Column) -> Column:
    return F.log10(n)
