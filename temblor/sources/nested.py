"""Origins, their magnitudes and arrivals of parsed events as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from temblor.schema import ARRIVAL_SCHEMA, MAGNITUDE_SCHEMA, ORIGIN_SCHEMA


def flatten_origins(records: DataFrame) -> DataFrame:
    """One row per event, origin and magnitude; events without origins keep one row.

    Columns are ``unid``, the origin fields prefixed ``origin_`` and the magnitude fields
    prefixed ``mag_``.
    """
    origins = records.select("unid", F.explode_outer("origins.origins").alias("o"))
    mags = origins.select("unid", "o", F.explode_outer("o.mags").alias("m"))
    return mags.select(
        "unid",
        *[
            F.col(f"o.{name}").alias(f"origin_{name.lower()}")
            for name in ORIGIN_SCHEMA.fieldNames()
            if name != "mags"
        ],
        *[
            F.col(f"m.{name}").alias(f"mag_{name.lower()}")
            for name in MAGNITUDE_SCHEMA.fieldNames()
        ],
    )


def flatten_arrivals(records: DataFrame) -> DataFrame:
    """One row per event and arrival; events without arrivals keep one row."""
    arrivals = records.select("unid", F.explode_outer("arrivals").alias("a"))
    return arrivals.select(
        "unid",
        *[
            F.col(f"a.{name}").alias(f"arrival_{name.lower()}")
            for name in ARRIVAL_SCHEMA.fieldNames()
        ],
    )
