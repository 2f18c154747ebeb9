"""The given ``events`` and ``nation`` tables seen as an earthquake catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from temblor.schema import EVENT_COLUMNS

# ``ts`` is stored without zone. Read as TIMESTAMP it is taken as UTC, whatever the session
# zone is, and comparisons with it still reach the scan.
EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)

# Degrees are spread over this many steps, so any user id gives a valid position.
LATITUDES = 150
REGIONS = 25


def as_quakes(events: DataFrame, nation: DataFrame) -> DataFrame:
    """The 13 event columns derived from raw events.

    The region name comes from a left join with ``nation`` (25 rows by definition of the
    table; Spark broadcasts it only if its size is below the session's limit). The key is
    made unique first, so Catalyst removes the join when no region is asked for.
    """
    names = nation.dropDuplicates(["n_nationkey"]).selectExpr(
        "n_nationkey AS _region_key", "n_name AS flynn_region"
    )
    placed = events.selectExpr(
        "CAST(event_id AS STRING) AS unid",
        f"user_id % {LATITUDES} * 1.2D - 90 AS lat",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 3.6D - 180 AS lon",
        "ts AS time",
        "value / 50 AS mag",
        """CASE event_type WHEN 'click' THEN 'Mw' WHEN 'view' THEN 'ML' WHEN 'error' THEN 'mb'
           WHEN 'signup' THEN 'Ms' ELSE 'Md' END AS magtype""",
        "event_id % 7000 / 10.0D AS depth",
        "'ke' AS evtype",
        "CAST(event_id AS STRING) AS source_id",
        "CASE WHEN event_id % 4 = 0 THEN 'LOCAL' ELSE 'SYNTH' END AS source_catalog",
        "ts + INTERVAL '2' MINUTE AS lastupdate",
        "CASE WHEN event_id % 3 = 0 THEN 'OBS' ELSE 'DRV' END AS author",
        f"CAST(user_id % {REGIONS} AS INT) AS _region_key",
    )
    return placed.join(names, "_region_key", "left").select(*EVENT_COLUMNS)


def read_quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_quakes(
        spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"),
        spark.read.parquet(f"{sf_dir}/nation.parquet"),
    )


def stream_quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ``events`` as a stream."""
    stream = (
        spark.readStream.schema(EVENTS_SCHEMA)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    return as_quakes(stream, spark.read.parquet(f"{sf_dir}/nation.parquet"))
