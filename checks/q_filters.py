"""Filters, the catalogue query, orders, pages, quality rules, retention and versions."""

import uuid
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from checks import landing
from checks.registry import ROWS_SQL, check, rows
from temblor.operators import filters as f, ordering, quality, retention, stats, versions
from temblor.operators.ordering import chronological_events, newest_events
from temblor.operators.query import QueryParams, constrain, query_events
from temblor.session import new_work_folder
from temblor.sources.event_table import append_events, read_events, write_events
from temblor.sources.geojson import empty_events
from temblor.sources.quakes import read_quakes


def _where(condition: str) -> str:
    return f"SELECT {ROWS_SQL} FROM quakes WHERE {condition}"


@check("events_in_range", _where(
    "time BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-15 12:00:00'"))
def _(spark, sf_dir):
    span = datetime(2024, 1, 10), datetime(2024, 1, 15, 12)
    return rows(f.events_in_range(read_quakes(spark, sf_dir), *span))


@check("events_in_bbox", _where("lat BETWEEN -30 AND 30 AND lon BETWEEN -60 AND 60"))
def _(spark, sf_dir):
    return rows(f.events_in_bbox(read_quakes(spark, sf_dir), -30, 30, -60, 60))


@check("events_above_magnitude", _where("mag >= 2"))
def _(spark, sf_dir):
    return rows(f.events_above_magnitude(read_quakes(spark, sf_dir), 2.0))


CONSTRAINTS = {
    "q_time": (
        {"start": datetime(2024, 1, 20), "end": datetime(2024, 1, 21)},
        "time >= TIMESTAMP '2024-01-20' AND time <= TIMESTAMP '2024-01-21'",
    ),
    "q_box": (
        {"minlat": -10.0, "maxlat": 45.5, "minlon": 0.0, "maxlon": 90.0},
        "lat >= -10 AND lat <= 45.5 AND lon >= 0 AND lon <= 90",
    ),
    "q_depth": ({"mindepth": 33.0, "maxdepth": 70.0}, "depth >= 33 AND depth <= 70"),
    "q_magnitude": ({"minmag": 1.5, "maxmag": 3.0}, "mag >= 1.5 AND mag <= 3"),
    "q_magtype": ({"magtype": "mw"}, "lower(magtype) = 'mw'"),
    "q_event_id": ({"eventid": "42"}, "unid = '42'"),
    "q_contributor": ({"contributor": "DRV"}, "author = 'DRV'"),
    "q_catalog": ({"catalog": "SYNTH"}, "source_catalog = 'SYNTH'"),
    "q_updated_after": (
        {"updatedafter": datetime(2024, 1, 25, 6)},
        "lastupdate > TIMESTAMP '2024-01-25 06:00:00'",
    ),
}


def _register_constraint(name: str, params: dict, condition: str) -> None:
    @check(name, _where(condition))
    def _(spark, sf_dir):
        return rows(constrain(read_quakes(spark, sf_dir), QueryParams.from_dict(params)))


for _name, (_params, _condition) in CONSTRAINTS.items():
    _register_constraint(_name, _params, _condition)


DISTANCE_SQL = """2 * 6371.0088 * asin(sqrt(least(1.0,
  pow(sin(radians(lat - 10) / 2), 2)
  + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon - 20) / 2), 2))))"""


@check("q_circle", _where(f"{DISTANCE_SQL} BETWEEN 500 AND 2000"))
def _(spark, sf_dir):
    around = QueryParams(lat=10.0, lon=20.0, minradius=500_000.0, maxradius=2_000_000.0)
    return rows(constrain(read_quakes(spark, sf_dir), around))


@check("circle_by_place", _where(f"{DISTANCE_SQL} <= 2000"))
def _(spark, sf_dir):
    # A table laid out along a curve through places.
    path = new_work_folder(spark, "places")
    write_events(read_quakes(spark, sf_dir), path, layout="place")
    around = QueryParams(lat=10.0, lon=20.0, maxradius=2_000_000.0)
    return rows(constrain(read_events(spark, path), around))


@check("query_events", _where("mag >= 1") + " ORDER BY time DESC, unid LIMIT 5 OFFSET 3")
def _(spark, sf_dir):
    return rows(query_events(read_quakes(spark, sf_dir), QueryParams(minmag=1.0, limit=5, offset=3)))


@check("q_limit", _where("true") + " ORDER BY time DESC, unid LIMIT 50")
def _(spark, sf_dir):
    return rows(query_events(read_quakes(spark, sf_dir), QueryParams()))


@check("q_offset", _where("true") + " ORDER BY time, unid LIMIT 1500 OFFSET 700")
def _(spark, sf_dir):
    deep = QueryParams(orderby="time-asc", limit=1500, offset=700)
    return rows(query_events(read_quakes(spark, sf_dir), deep))


@check("q_order_by_deep", _where("true") + " ORDER BY mag DESC, time DESC, unid LIMIT 1000 OFFSET 2500")
def _(spark, sf_dir):
    deep = QueryParams(orderby="magnitude", limit=1000, offset=2500)
    return rows(query_events(read_quakes(spark, sf_dir), deep))


@check("q_order_by", f"""
SELECT * FROM (SELECT 'magnitude' AS orderby, {ROWS_SQL} FROM quakes
               ORDER BY mag DESC, time DESC, unid LIMIT 20)
UNION ALL
SELECT * FROM (SELECT 'magnitude-asc' AS orderby, {ROWS_SQL} FROM quakes
               ORDER BY mag, time DESC, unid LIMIT 20)
UNION ALL
SELECT * FROM (SELECT 'time' AS orderby, {ROWS_SQL} FROM quakes
               ORDER BY time DESC, unid LIMIT 20)
UNION ALL
SELECT * FROM (SELECT 'time-asc' AS orderby, {ROWS_SQL} FROM quakes
               ORDER BY time, unid LIMIT 20)""")
def _(spark, sf_dir):
    quakes = read_quakes(spark, sf_dir)
    pages = [
        rows(query_events(quakes, QueryParams(orderby=name, limit=20))).withColumn(
            "orderby", F.lit(name)
        )
        for name in ("magnitude", "magnitude-asc", "time", "time-asc")
    ]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


@check("chronological_events", _where("true") + " ORDER BY time, unid")
def _(spark, sf_dir):
    return rows(chronological_events(read_quakes(spark, sf_dir)))


@check("newest_events", _where("true") + " ORDER BY time DESC, unid LIMIT 2000")
def _(spark, sf_dir):
    return rows(newest_events(read_quakes(spark, sf_dir), 2000))


@check("mag_depth_pairs", "SELECT mag, depth FROM quakes")
def _(spark, sf_dir):
    return f.mag_depth_pairs(read_quakes(spark, sf_dir))


@check("column_subset", "SELECT count(mag) AS n, max(depth) AS deepest FROM quakes")
def _(spark, sf_dir):
    return read_quakes(spark, sf_dir).agg(
        F.count("mag").alias("n"), F.max("depth").alias("deepest")
    )


@check("tag_section", """
SELECT 'Regions' AS title, flynn_region, count(*) AS n FROM quakes GROUP BY flynn_region""")
def _(spark, sf_dir):
    regions = read_quakes(spark, sf_dir).groupBy("flynn_region").agg(F.count("*").alias("n"))
    return f.tag_section(regions, "Regions")


# Doubled magnitudes, stretched positions and depths, so that some rows break the rules.
@check("quarantine_events", """
WITH q AS (SELECT unid, mag * 2.5::DOUBLE - 2.01::DOUBLE AS mag, lat * 1.1::DOUBLE AS lat,
                  lon * 1.05::DOUBLE AS lon, depth * 1.02::DOUBLE - 5 AS depth FROM quakes),
e AS (SELECT unid, concat_ws(';',
        CASE WHEN NOT mag BETWEEN -2 AND 10 THEN 'mag out of range' END,
        CASE WHEN NOT depth BETWEEN 0 AND 700 THEN 'depth out of range' END,
        CASE WHEN NOT lat BETWEEN -90 AND 90 THEN 'lat out of range' END,
        CASE WHEN NOT lon BETWEEN -180 AND 180 THEN 'lon out of range' END) AS errors FROM q)
SELECT unid, errors, errors = '' AS valid FROM e""")
def _(spark, sf_dir):
    stretched = read_quakes(spark, sf_dir).withColumns({
        "mag": F.col("mag") * 2.5 - 2.01,
        "lat": F.col("lat") * 1.1,
        "lon": F.col("lon") * 1.05,
        "depth": F.col("depth") * 1.02 - 5,
    })
    valid, invalid = quality.quarantine_events(stretched)
    good = valid.select("unid", F.lit("").alias("errors"), F.lit(True).alias("valid"))
    bad = invalid.select("unid", F.array_join("errors", ";").alias("errors"), F.lit(False).alias("valid"))
    return good.unionByName(bad)


AS_OF = datetime(2024, 1, 31)
CONFIG = retention.RetentionConfig(max_events=1500, retention_days=10)


@check("retention_old_count", "SELECT count(*) AS count FROM quakes WHERE time < TIMESTAMP '2024-01-21'")
def _(spark, sf_dir):
    return retention.retention_old_count(read_quakes(spark, sf_dir), CONFIG.cutoff(AS_OF))


@check("retention_keep", _where("time >= TIMESTAMP '2024-01-21'"))
def _(spark, sf_dir):
    return rows(retention.retention_keep(read_quakes(spark, sf_dir), CONFIG.cutoff(AS_OF)))


@check("retention", _where("time >= TIMESTAMP '2024-01-21'") + " ORDER BY time DESC, unid LIMIT 1500")
def _(spark, sf_dir):
    return rows(retention.apply_retention(read_quakes(spark, sf_dir), AS_OF, CONFIG))


@check("new_events_only", _where("time > TIMESTAMP '2024-01-16'"))
def _(spark, sf_dir):
    # Every event arrives twice, the first half of the month is known.
    quakes = read_quakes(spark, sf_dir)
    known = f.events_in_range(quakes, datetime(2024, 1, 1), datetime(2024, 1, 16))
    return rows(versions.new_events_only(quakes.unionByName(quakes), known))


@check("append_event", _where("true"))
def _(spark, sf_dir):
    # Known events in a new batch add nothing.
    quakes = read_quakes(spark, sf_dir)
    return rows(versions.add_events(quakes, landing.repeated(quakes)))


@check("append_events", _where("true") + f" UNION ALL SELECT {ROWS_SQL} FROM quakes WHERE magtype = 'Ms'")
def _(spark, sf_dir):
    quakes = read_quakes(spark, sf_dir)
    return rows(append_events(quakes, landing.repeated(quakes)))


@check("upsert_events", """
SELECT unid, mag + CASE WHEN magtype = 'mb' THEN 0.5 ELSE 0 END AS mag FROM quakes""")
def _(spark, sf_dir):
    quakes = read_quakes(spark, sf_dir)
    return versions.upsert_events(quakes, landing.updated(quakes)).select("unid", "mag")


@check("upsert_first_older", "SELECT unid, mag FROM quakes")
def _(spark, sf_dir):
    # A known event stays, also if the batch dates its own version earlier.
    quakes = read_quakes(spark, sf_dir)
    older = landing.disorder(quakes).filter("magtype = 'ML'")
    return versions.upsert_events(quakes, older, "first").select("unid", "mag")


def _with_nan(spark, sf_dir):
    mag = F.when(F.col("magtype") == "Ms", F.lit(float("nan"))).when(F.col("magtype") != "Md", F.col("mag"))
    return read_quakes(spark, sf_dir).withColumn("mag", mag)


@check("q_page_nan", """
WITH s AS (SELECT unid, time, CASE WHEN magtype = 'Ms' THEN 'NaN'::DOUBLE WHEN magtype = 'Md' THEN NULL ELSE mag END AS m
           FROM quakes)
SELECT unid FROM s ORDER BY m DESC NULLS LAST, time DESC, unid LIMIT 700 OFFSET (SELECT count(*) - 500 FROM quakes)""")
def _(spark, sf_dir):
    events = _with_nan(spark, sf_dir)
    return ordering.page(events, "magnitude", 700, events.count() - 500).select("unid")


@check("q_last_page", """
SELECT unid FROM quakes ORDER BY time, unid OFFSET (SELECT count(*) - 300 FROM quakes)""")
def _(spark, sf_dir):
    events = read_quakes(spark, sf_dir)
    return ordering.page(events, "time-asc", 5000, events.count() - 300).select("unid")


@check("constant_depth_stats", """
SELECT 599.9::DOUBLE AS mean_depth, 599.9::DOUBLE AS median_depth, 0.0::DOUBLE AS std_depth,
       599.9::DOUBLE AS min_depth, 599.9::DOUBLE AS max_depth FROM (SELECT count(*) FROM quakes)""")
def _(spark, sf_dir):
    fixed = read_quakes(spark, sf_dir).withColumn("depth", F.lit(599.9))
    return stats.depth_stats(fixed).withColumn("mean_depth", F.round("mean_depth", 9))


@check("empty_events", _where("true"))
def _(spark, sf_dir):
    # The typed empty table takes the events as they are.
    return rows(append_events(empty_events(spark), read_quakes(spark, sf_dir)))


@check("map_events", "SELECT unid, round(11.8 + 1.5::DOUBLE * mag, 9) AS log_energy FROM quakes")
def _(spark, sf_dir):
    def log_energy(batches):
        for batch in batches:
            yield pd.DataFrame({"unid": batch["unid"], "log_energy": 11.8 + 1.5 * batch["mag"]})

    mapped = f.map_events(
        read_quakes(spark, sf_dir).select("unid", "mag"), log_energy,
        "unid STRING, log_energy DOUBLE",
    )
    return mapped.withColumn("log_energy", F.round("log_energy", 9))


@check("event_frame", """
SELECT flynn_region, magtype, count(*) AS n FROM quakes WHERE depth > 300 GROUP BY 1, 2""")
def _(spark, sf_dir):
    view = f"quakes_{uuid.uuid4().hex}"
    f.event_frame(read_quakes(spark, sf_dir), view)
    return spark.sql(
        f"SELECT flynn_region, magtype, count(*) AS n FROM {view} WHERE depth > 300 GROUP BY 1, 2"
    )
