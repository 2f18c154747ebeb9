"""Sources and sinks, over texts and files that Spark derives from the given tables."""

from datetime import datetime

from pyspark.sql import functions as F

from checks import landing
from checks.registry import ROWS_SQL, check, rows
from temblor.operators import geo
from temblor.operators.retention import RetentionConfig
from temblor.plans import report, summary as results, upkeep
from temblor.plans.store import Store, read_store, read_store_summary, store_page
from temblor.session import new_work_folder
from temblor.sources import event_table, geojson, messages, nested
from temblor.sources.quakes import read_quakes

ALL_ROWS_SQL = f"SELECT {ROWS_SQL} FROM quakes"
# Members per collection body; a response of the catalogue service holds at most 20,000.
BODY_SIZE = 500


def _bodies(quakes, feature):
    """FeatureCollection texts of neighbouring events."""
    body = F.floor(F.col("unid").cast("bigint") / BODY_SIZE)
    members = quakes.select(body.alias("body"), feature.alias("feature"))
    collected = members.groupBy("body").agg(
        F.array_join(F.collect_list("feature"), ",").alias("features")
    )
    return collected.select(
        "body",
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['), F.col("features"), F.lit("]}")
        ).alias("value")
    )


@check("read_feature_collection", ALL_ROWS_SQL)
def _(spark, sf_dir):
    # One file for each body, as a client would store its responses.
    path = new_work_folder(spark, "bodies")
    _bodies(read_quakes(spark, sf_dir), geojson.feature_json()).write.partitionBy("body").text(path)
    return rows(geojson.to_event_table(geojson.read_feature_collection(spark, path)))


@check("read_feature_collection_quarantine", """
SELECT CASE magtype WHEN 'Md' THEN 'bad or missing: mag' WHEN 'Ms' THEN 'not a feature' END AS error,
       count(*) AS n FROM quakes GROUP BY 1""")
def _(spark, sf_dir):
    # One kind of event loses its magnitude, another is no object at all.
    text = geojson.feature_json()
    spoiled = (
        F.when(F.col("magtype") == "Md", F.regexp_replace(text, '"mag":[^,]*', '"mag":"big"'))
        .when(F.col("magtype") == "Ms", F.lit("17"))
        .otherwise(text)
    )
    bodies = _bodies(read_quakes(spark, sf_dir), spoiled)
    parsed = geojson.read_collections(bodies.select("value"), mode="quarantine")
    return parsed.groupBy("error").agg(F.count("*").alias("n"))


@check("to_event_table", f"SELECT {ROWS_SQL}, evtype, source_id, source_catalog, author FROM quakes")
def _(spark, sf_dir):
    features = geojson.to_features(read_quakes(spark, sf_dir), "feature")
    table = geojson.to_event_table(geojson.parse_features(features))
    return table.select(
        *rows(table).columns, "evtype", "source_id", "source_catalog", "author"
    )


@check("to_event_records", """
SELECT unid, lat, lon, lon AS x, lat AS y, CASE WHEN magtype = 'Mw' THEN 0 ELSE depth END AS depth,
       CASE WHEN magtype = 'ML' THEN '' ELSE flynn_region END AS flynn_region, author AS auth
FROM quakes""")
def _(spark, sf_dir):
    # Some depths and regions are missing in the table.
    holes = read_quakes(spark, sf_dir).withColumns({
        "depth": F.when(F.col("magtype") != "Mw", F.col("depth")),
        "flynn_region": F.when(F.col("magtype") != "ML", F.col("flynn_region")),
    })
    records = geojson.to_event_records(holes)
    return records.select(
        "unid", "lat", "lon",
        F.col("geometry.coordinates")[0].alias("x"), F.col("geometry.coordinates")[1].alias("y"),
        "depth", "flynn_region", "auth",
    )


@check("write_feature_collection", ALL_ROWS_SQL)
def _(spark, sf_dir):
    path = new_work_folder(spark, "features")
    geojson.write_feature_collection(read_quakes(spark, sf_dir), path)
    return rows(geojson.read_feature_lines(spark, path))


MESSAGES_SQL = """
WITH m AS (
  SELECT 'create' AS action, unid, mag, '' AS error FROM quakes
  UNION ALL SELECT 'update', unid, mag + 0.5, '' FROM quakes WHERE magtype = 'mb'
  UNION ALL SELECT 'create', unid, mag, '' FROM quakes WHERE magtype = 'Ms'
  UNION ALL SELECT NULL, NULL, NULL, 'bad or missing: action' FROM quakes WHERE magtype = 'Md')
"""


@check("read_event_messages", MESSAGES_SQL + "SELECT action, unid, mag, error FROM m")
def _(spark, sf_dir):
    parsed = messages.read_event_messages(spark, landing.landed_messages(spark, sf_dir))
    return parsed.select("action", "unid", "mag", F.coalesce("error", F.lit("")).alias("error"))


@check("section_json", """
WITH t AS (SELECT flynn_region, count(*) AS event_count FROM quakes GROUP BY 1
           ORDER BY event_count DESC, flynn_region LIMIT 10)
SELECT '[' || string_agg('{"flynn_region":"' || flynn_region || '","event_count":' || event_count
       || '}', ',' ORDER BY event_count DESC, flynn_region) || ']' AS data FROM t""")
def _(spark, sf_dir):
    top = geo.top_regions(geo.region_stats(read_quakes(spark, sf_dir))).select(
        "flynn_region", "event_count"
    )
    return report.section_json(top, -F.col("event_count"), F.col("flynn_region"))


@check("load_mode", """
SELECT 'append' AS step, unid, 2::BIGINT AS n FROM quakes UNION ALL SELECT 'clear', unid, 1 FROM quakes""")
def _(spark, sf_dir):
    quakes = read_quakes(spark, sf_dir)
    read_back = []
    for step, modes in (("append", (True, False)), ("clear", (True, False, True))):
        path = new_work_folder(spark, "load")
        for clear in modes:
            event_table.write_events(quakes, path, clear)
        rows_left = event_table.read_events(spark, path).groupBy("unid").agg(F.count("*").alias("n"))
        read_back.append(rows_left.select(F.lit(step).alias("step"), "unid", "n"))
    return read_back[0].unionByName(read_back[1])


@check("load_events", """
SELECT CAST(CAST(k AS DOUBLE) / 10 AS DOUBLE) AS bin, count(*) AS n FROM quakes GROUP BY k""")
def _(spark, sf_dir):
    # The store is filled, then a batch brings the known events again and those still missing.
    quakes = read_quakes(spark, sf_dir)
    store = Store(new_work_folder(spark, "store"))
    upkeep.load_events(spark, quakes.filter("magtype != 'mb'"), store, "first", clear=True)
    upkeep.load_events(spark, quakes.unionByName(landing.repeated(quakes)), store, "second")
    counts = results.magnitude_counts(read_store_summary(spark, store))
    return counts.select((F.col("mag_key") / 10).alias("bin"), "n")


@check("store_page", f"""
SELECT * FROM (SELECT 'time' AS orderby, {ROWS_SQL} FROM quakes ORDER BY time DESC, unid LIMIT 40 OFFSET 600)
UNION ALL
SELECT * FROM (SELECT 'magnitude', {ROWS_SQL} FROM quakes ORDER BY mag DESC, time DESC, unid LIMIT 40 OFFSET 600)""")
def _(spark, sf_dir):
    # Deep pages whose ends the summary knows.
    store = Store(new_work_folder(spark, "pages"))
    upkeep.load_events(spark, read_quakes(spark, sf_dir), store, "a")
    found = [rows(store_page(spark, store, order, 40, 600)).select(F.lit(order).alias("orderby"), "*") for order in ("time", "magnitude")]
    return found[0].unionByName(found[1])


@check("load_events_twice", """
SELECT unid, CASE WHEN magtype = 'Ms' THEN 2 ELSE 1 END::BIGINT AS n FROM quakes
UNION ALL SELECT 'in the summary', count(*) + count(*) FILTER (WHERE magtype = 'Ms') FROM quakes""")
def _(spark, sf_dir):
    # Loads that are run again, one of them without dedupe, replace themselves.
    quakes = read_quakes(spark, sf_dir)
    store = Store(new_work_folder(spark, "twice"))
    for load, part, dedupe in (("a", "magtype != 'mb'", True), ("b", "true", True), ("c", "magtype = 'Ms'", False)):
        for _ in range(2):
            upkeep.load_events(spark, quakes.filter(part), store, load, dedupe=dedupe)
    left = read_store(spark, store).groupBy("unid").agg(F.count("*").alias("n"))
    counted = results.data_stats(read_store_summary(spark, store))
    return left.unionByName(counted.select(F.lit("in the summary").alias("unid"), F.col("total_events").alias("n")))


@check("retention_job", """
WITH left_over AS (
  SELECT k FROM quakes WHERE time >= TIMESTAMP '2024-01-21' ORDER BY time DESC, unid LIMIT 1500)
SELECT CAST(CAST(k AS DOUBLE) / 10 AS DOUBLE) AS bin, count(*) AS n FROM left_over GROUP BY k""")
def _(spark, sf_dir):
    # Whole dates go, the boundary's date is cut, in place.
    store = Store(new_work_folder(spark, "kept"))
    config = RetentionConfig(max_events=1500, retention_days=10)
    upkeep.load_events(spark, read_quakes(spark, sf_dir), store, "all")
    upkeep.run_retention(spark, store, datetime(2024, 1, 31), config)
    counts = results.magnitude_counts(read_store_summary(spark, store))
    return counts.select((F.col("mag_key") / 10).alias("bin"), "n")


@check("auto_cleanup", """
WITH left_over AS (
  SELECT unid, mag FROM quakes WHERE time >= TIMESTAMP '2024-01-21' ORDER BY time DESC, unid LIMIT 1500)
SELECT unid, mag FROM left_over""")
def _(spark, sf_dir):
    # Retention after each load: what an earlier load has lost does not come back with the next.
    quakes = read_quakes(spark, sf_dir)
    store = Store(new_work_folder(spark, "cleanup"))
    config = RetentionConfig(max_events=1500, retention_days=10)
    for load, part in (("odd", 1), ("even", 0)):
        half = quakes.filter(F.col("unid").cast("bigint") % 2 == part)
        upkeep.load_events(spark, half, store, load, as_of=datetime(2024, 1, 31), retention=config)
    return read_store(spark, store).select("unid", "mag")


@check("load_checked", """
SELECT 'kept' AS state, unid FROM quakes WHERE mag <= 1.5 AND flynn_region IS NOT NULL
UNION ALL SELECT 'set aside', unid FROM quakes WHERE NOT (mag <= 1.5 AND flynn_region IS NOT NULL)""")
def _(spark, sf_dir):
    # Events that the scale makes too large for a magnitude are set aside by the load.
    store = Store(new_work_folder(spark, "checked"))
    quakes = read_quakes(spark, sf_dir).withColumn("mag", F.col("mag") * 10 / 1.5)
    upkeep.load_events(spark, quakes, store, "a", check=True)
    bad = spark.read.parquet(store.rejects).select(F.lit("set aside").alias("state"), "unid")
    return read_store(spark, store).select(F.lit("kept").alias("state"), "unid").unionByName(bad)


@check("clear", "SELECT unid, 'loaded' AS state FROM quakes")
def _(spark, sf_dir):
    loaded, cleared = (Store(new_work_folder(spark, kind)) for kind in ("loaded", "cleared"))
    quakes = read_quakes(spark, sf_dir)
    for store in (loaded, cleared):
        upkeep.load_events(spark, quakes, store, "a")
    upkeep.clear_all(spark, cleared)
    left = read_store(spark, cleared).select("unid", F.lit("left").alias("state"))
    counted = results.magnitude_counts(read_store_summary(spark, cleared)).select(
        F.col("mag_key").cast("string").alias("unid"), F.lit("counted").alias("state"))
    return read_store(spark, loaded).select("unid", F.lit("loaded").alias("state")).unionByName(
        left).unionByName(counted)


def _nested(quakes):
    """Feature texts with one origin (two magnitudes) per event and arrivals for some."""
    mags = F.array(
        F.struct(F.col("mag").alias("Value"), F.col("magtype").alias("Type"), F.lit(7).alias("Nsta")),
        F.struct((F.col("mag") + 0.25).alias("Value"), F.lit("m").alias("Type"),
                 F.lit(None).cast("int").alias("Nsta")),
    )
    origin = F.struct(
        F.col("source_id").alias("Source_id"), F.col("source_catalog").alias("Source_catalog"),
        F.col("lastupdate").alias("Lastupdate"), F.col("time").alias("Time"),
        F.col("lat").alias("Lat"), F.col("lon").alias("Lon"), F.col("depth").alias("Depth"),
        F.lit(12).alias("Ndef"), mags.alias("mags"),
    )
    origins = F.struct(
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.array(origin).alias("origins"),
    )
    arrival = F.struct(
        F.concat("unid", F.lit("-1")).alias("id"), F.lit("STA").alias("Sta"),
        (F.col("depth") / 2).alias("Dist"), F.lit("P").alias("Phase"),
    )
    arrivals = F.when(F.col("magtype") == "Mw", F.array(arrival))
    text = geojson.feature_json(origins=origins, arrivals=arrivals)
    return geojson.parse_features(quakes.select(text.alias("feature")))


@check("flatten_origins", """
SELECT unid, source_id AS origin_source_id, depth AS origin_depth, 12 AS origin_ndef,
       mag AS mag_value, magtype AS mag_type, 7 AS mag_nsta FROM quakes
UNION ALL
SELECT unid, source_id, depth, 12, mag + 0.25, 'm', NULL FROM quakes""")
def _(spark, sf_dir):
    return nested.flatten_origins(_nested(read_quakes(spark, sf_dir))).select(
        "unid", "origin_source_id", "origin_depth", "origin_ndef", "mag_value", "mag_type", "mag_nsta"
    )


@check("flatten_arrivals", """
SELECT unid, CASE WHEN magtype = 'Mw' THEN unid || '-1' END AS arrival_id,
       CASE WHEN magtype = 'Mw' THEN depth / 2 END AS arrival_dist,
       CASE WHEN magtype = 'Mw' THEN 'P' END AS arrival_phase FROM quakes""")
def _(spark, sf_dir):
    return nested.flatten_arrivals(_nested(read_quakes(spark, sf_dir))).select(
        "unid", "arrival_id", "arrival_dist", "arrival_phase"
    )
