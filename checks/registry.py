"""Registered queries: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The catalogue of temblor.sources.quakes in SQL.
QUAKES_SQL = """quakes AS (
  SELECT CAST(e.event_id AS VARCHAR) AS unid,
         e.user_id % 150 * 1.2::DOUBLE - 90 AS lat,
         CAST(regexp_extract(e.props, '([0-9]+)', 1) AS DOUBLE) * 3.6::DOUBLE - 180 AS lon,
         e.ts AS time,
         e.value / 50 AS mag,
         CASE e.event_type WHEN 'click' THEN 'Mw' WHEN 'view' THEN 'ML' WHEN 'error' THEN 'mb'
              WHEN 'signup' THEN 'Ms' ELSE 'Md' END AS magtype,
         CAST(e.event_id % 7000 AS DOUBLE) / 10 AS depth,
         'ke' AS evtype,
         n.n_name AS flynn_region,
         CAST(e.event_id AS VARCHAR) AS source_id,
         CASE WHEN e.event_id % 4 = 0 THEN 'LOCAL' ELSE 'SYNTH' END AS source_catalog,
         e.ts + INTERVAL 2 MINUTE AS lastupdate,
         CASE WHEN e.event_id % 3 = 0 THEN 'OBS' ELSE 'DRV' END AS author,
         CAST(trunc(e.value / 50 * 10) AS BIGINT) AS k
  FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 25
)"""

# The catalogue after the updates of checks.landing: what the newest versions say.
LIVE_SQL = QUAKES_SQL.replace("quakes AS", "raw AS", 1) + """, quakes AS (
  SELECT * REPLACE (CASE WHEN magtype = 'mb' THEN mag + 0.5 ELSE mag END AS mag,
                    CASE WHEN magtype = 'mb' THEN lastupdate + INTERVAL 1 HOUR ELSE lastupdate END AS lastupdate,
                    CAST(trunc(CASE WHEN magtype = 'mb' THEN mag + 0.5 ELSE mag END * 10) AS BIGINT) AS k)
  FROM raw)"""

# The catalogue after checks.landing.disorder: late versions that lose, one that wins a tie, late events.
DISORDER_SQL = QUAKES_SQL.replace("quakes AS", "raw AS", 1) + """, quakes AS (
  SELECT * REPLACE (CAST(trunc(greatest(mag, 0) * 10) AS BIGINT) AS k) FROM (
    SELECT * REPLACE (CASE WHEN magtype = 'Md' THEN mag - 0.25 ELSE mag END AS mag) FROM raw
    UNION ALL SELECT * REPLACE ('L' || unid AS unid, lastupdate - INTERVAL 730 DAY AS lastupdate) FROM raw WHERE magtype = 'Ms'
    UNION ALL SELECT * REPLACE ('F' || unid AS unid, lastupdate + INTERVAL 20000 DAY AS lastupdate) FROM raw WHERE magtype = 'Ms'))"""

# Columns that row-returning queries hand out.
ROWS_SQL = (
    "unid, lat, lon, epoch_us(time) AS time_us, mag, magtype, depth, flynn_region, "
    "epoch_us(lastupdate) AS lastupdate_us"
)
ROW_COLUMNS = ("unid", "lat", "lon", "time", "mag", "magtype", "depth", "flynn_region", "lastupdate")


def check(name: str, sql: str | None = None, live: bool = False, catalogue: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may read the ``quakes`` catalogue, with ``live`` after its updates, or
    as ``catalogue`` has it."""
    base = catalogue or (LIVE_SQL if live else QUAKES_SQL)

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: portable(function(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            tail = ", " + body[5:] if body.upper().startswith("WITH ") else "\n" + body
            ORACLES[name] = f"WITH {base}{tail}"
        return function

    return register


def portable(result: DataFrame) -> DataFrame:
    """Times as microseconds and dates as text: the same value in every client and zone."""
    awkward = (T.TimestampType, T.DateType)
    if not any(isinstance(field.dataType, awkward) for field in result.schema):
        return result
    columns = []
    for field in result.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            columns.append(F.unix_micros(column).alias(f"{field.name}_us"))
        elif isinstance(field.dataType, T.DateType):
            columns.append(column.cast("string").alias(field.name))
        else:
            columns.append(column)
    return result.select(*columns)


def rows(events: DataFrame) -> DataFrame:
    return events.select(*ROW_COLUMNS)


def rounded(result: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Round sums of doubles, whose last digits depend on the order of addition."""
    return result.withColumns({n: F.round(n, places) for n in names})
