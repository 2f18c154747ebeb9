"""Streams that run to the end of their input; their tables must equal the batch results."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import landing
from checks.q_geo import CLUSTERS_SQL, HOTSPOTS_SQL
from checks.q_magnitude import BINS_SQL, HISTOGRAM_SQL
from checks.q_risk import RISK_COLUMNS_SQL, SPAN_SQL, portable_risk
from checks.q_temporal import DAILY_SQL, HOURLY_SQL, MONTHLY_SQL
from checks.registry import DISORDER_SQL, ROWS_SQL, check, rows
from temblor.plans import summary as results
from temblor.plans.processors import Processor, part
from temblor.plans.states import active_days, largest, state_results, summarize_states
from temblor.plans.store import Store, read_store, read_store_states, read_store_summary
from temblor.schema import EVENT_SCHEMA
from temblor.session import new_work_folder, paths_like
from temblor.sources import messages
from temblor.functions.calendar import DATE_COLUMN
from temblor.sources.quakes import read_quakes
from temblor.streaming import incremental, ingest

# A run that hangs must not hang its caller.
TIMEOUT_S = 3600
FILES_PER_BATCH = 16
LOG_BATCHES = 5

_DONE: dict[tuple[str, str, str], str] = {}


def _finish(query) -> None:
    if not query.awaitTermination(TIMEOUT_S):
        query.stop()
        raise TimeoutError("the stream did not end")


def _once(spark: SparkSession, kind: str, sf_dir: str, run) -> str:
    """Output folder of a stream that is run once per application and data folder."""
    key = (spark.sparkContext.applicationId, kind, sf_dir)
    if key not in _DONE:
        root = new_work_folder(spark, kind)
        _finish(run(root))
        _DONE[key] = root
    return _DONE[key]


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    source = landing.landed_messages(spark, sf_dir)
    return _once(spark, "ingest", sf_dir, lambda root: ingest.start_ingest(
        messages.stream_event_messages(spark, source, files_per_batch=landing.files_of_batch(spark, sf_dir)), root
    ))


def _stored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored event table as a stream of several micro-batches."""
    return (
        spark.readStream.schema(f"{_ddl()}, {DATE_COLUMN} DATE")
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .parquet(landing.landed_table(spark, sf_dir))
        .drop(DATE_COLUMN)
    )


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA)


def _streamed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _once(spark, "summaries", sf_dir, lambda root: incremental.start_summaries(
        _stored_stream(spark, sf_dir), f"{root}/partial", f"{root}/checkpoint"
    ))
    return results.read_summary(spark, f"{root}/partial")


@check("stream_ingest", """
SELECT unid, mag, 'create' AS action FROM quakes
UNION ALL SELECT unid, mag + 0.5, 'update' FROM quakes WHERE magtype = 'mb'
UNION ALL SELECT unid, mag, 'create' FROM quakes WHERE magtype = 'Ms'""")
def _(spark, sf_dir):
    return ingest.read_versions(spark, _ingested(spark, sf_dir)).select("unid", "mag", "action")


@check("stream_skip_bad", """
SELECT '{"action":"create","data":{"id":"' || unid AS value, 'bad or missing: action' AS error
FROM quakes WHERE magtype = 'Md'""")
def _(spark, sf_dir):
    return ingest.read_rejects(spark, _ingested(spark, sf_dir)).select("value", "error")


@check("emit_events", """
SELECT 'create' AS action, count(*) + count(*) FILTER (WHERE magtype = 'Ms') AS n FROM quakes
UNION ALL SELECT 'update', count(*) FROM quakes WHERE magtype = 'mb'""")
def _(spark, sf_dir):
    sent = ingest.read_emitted(spark, _ingested(spark, sf_dir))
    return messages.parse_messages(sent).groupBy("action").agg(F.count("*").alias("n"))


@check("stream_first", f"SELECT {ROWS_SQL} FROM quakes")
def _(spark, sf_dir):
    return rows(ingest.read_current(spark, _ingested(spark, sf_dir), "first"))


@check("stream_latest", """
SELECT unid, CASE WHEN magtype = 'mb' THEN mag + 0.5 ELSE mag END AS mag,
       epoch_us(lastupdate) + CASE WHEN magtype = 'mb' THEN 3600000000 ELSE 0 END AS lastupdate_us
FROM quakes""")
def _(spark, sf_dir):
    current = ingest.read_current(spark, _ingested(spark, sf_dir), "latest")
    return current.select("unid", "mag", "lastupdate")


def _first_versions(spark: SparkSession, sf_dir: str, kind: str, log: str) -> DataFrame:
    """The log as a stream of several micro-batches through keyed state."""
    def run(root):
        # As many micro-batches whatever the log's size.
        files = len(paths_like(spark, f"{log}/versions/batch_id=*/*.parquet"))
        versions = ingest.stream_versions(spark, log, max(2, -(-files // LOG_BATCHES)))
        return incremental.start_first_versions(versions, f"{root}/unique", f"{root}/checkpoint", order=ingest.ARRIVAL)

    root = _once(spark, kind, sf_dir, run)
    return incremental.read_first_versions(spark, f"{root}/unique", EVENT_SCHEMA).select("unid", "mag")


@check("stream_dedupe", "SELECT unid, mag FROM quakes")
def _(spark, sf_dir):
    # Repeats and updates arrive in later micro-batches than the events themselves.
    return _first_versions(spark, sf_dir, "dedupe", _ingested(spark, sf_dir))


LATE_SQL = """
UNION ALL SELECT p.p || unid, mag FROM quakes, (VALUES ('L'), ('F')) AS p(p) WHERE magtype = 'Ms'"""


@check("stream_dedupe_late", "SELECT unid, mag FROM quakes" + LATE_SQL)
def _(spark, sf_dir):
    # Neither an event of two years ago nor one dated far ahead makes others disappear.
    return _first_versions(spark, sf_dir, "dedupe_late", _disordered(spark, sf_dir))


def _disordered(spark: SparkSession, sf_dir: str) -> str:
    source = landing.landed_disorder(spark, sf_dir)
    return _once(spark, "ingest_disorder", sf_dir, lambda root: ingest.start_ingest(
        messages.stream_event_messages(spark, source, files_per_batch=landing.files_of_batch(spark, sf_dir)), root
    ))


@check("stream_first_out_of_order", "SELECT unid, mag FROM quakes" + LATE_SQL)
def _(spark, sf_dir):
    return ingest.read_current(spark, _disordered(spark, sf_dir), "first").select("unid", "mag")


@check("stream_latest_tie", """
SELECT unid, CASE WHEN magtype = 'Md' THEN mag - 0.25 ELSE mag END AS mag FROM quakes""" + LATE_SQL)
def _(spark, sf_dir):
    return ingest.read_current(spark, _disordered(spark, sf_dir), "latest").select("unid", "mag")


def _live_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of messages with repeats and updates."""
    return _followed(spark, _ingested(spark, sf_dir))


def _followed(spark: SparkSession, root: str) -> DataFrame:
    """The summary brought up to date after every batch of the log, as a live one is."""
    for batch in sorted(int(p.rsplit("=", 1)[1]) for p in paths_like(spark, f"{root}/versions/batch_id=*")):
        incremental.follow_log(spark, root, Store(f"{root}/store"), upto=batch)
    return read_store_summary(spark, Store(f"{root}/store"))


@check("inc_magnitude_distribution", HISTOGRAM_SQL, live=True)
def _(spark, sf_dir):
    return results.magnitude_distribution(_live_summary(spark, sf_dir))


@check("inc_temporal", f"""
WITH d AS ({DAILY_SQL}), h AS ({HOURLY_SQL}), m AS ({MONTHLY_SQL})
SELECT 'day' AS unit, date AS key, count FROM d
UNION ALL SELECT 'hour', CAST(hour AS VARCHAR), count FROM h
UNION ALL SELECT 'month', CAST(month AS VARCHAR), count FROM m
UNION ALL SELECT 'weekday', strftime(min(time), '%a'), count(*) FROM quakes GROUP BY isodow(time)""", live=True)
def _(spark, sf_dir):
    summary = _live_summary(spark, sf_dir)
    tables = {
        "day": results.daily_counts(summary),
        "hour": results.hourly_frequency(summary),
        "month": results.monthly_frequency(summary),
        "weekday": results.weekly_frequency(summary).filter(F.col("count") > 0),
    }
    united = None
    for unit, table in tables.items():
        key = table.columns[0]
        shaped = table.select(
            F.lit(unit).alias("unit"), F.col(key).cast("string").alias("key"), "count"
        )
        united = shaped if united is None else united.unionByName(shaped)
    return united


@check("inc_pairs", "SELECT mag, depth FROM quakes")
def _(spark, sf_dir):
    root = _once(spark, "pairs", sf_dir, lambda root: incremental.start_pairs(
        _stored_stream(spark, sf_dir), f"{root}/pairs", f"{root}/checkpoint"
    ))
    return spark.read.schema("mag DOUBLE, depth DOUBLE").parquet(f"{root}/pairs")


@check("inc_hotspots", f"""
WITH r AS ({HOTSPOTS_SQL}), c AS ({CLUSTERS_SQL})
SELECT flynn_region AS region, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, count FROM r
UNION ALL SELECT NULL, lat, lon, count FROM c""", live=True)
def _(spark, sf_dir):
    summary = _live_summary(spark, sf_dir)
    nothing = F.lit(None).cast("double")
    regions = results.region_hotspots(summary).select(
        F.col("flynn_region").alias("region"), nothing.alias("lat"), nothing.alias("lon"), "count"
    )
    cells = results.coordinate_clusters(summary).select(
        F.lit(None).cast("string").alias("region"), "lat", "lon", "count"
    )
    return regions.unionByName(cells)


@check("inc_gr", BINS_SQL + """
SELECT round(regr_slope(ln(n), k / 10.0::DOUBLE), 6) AS b_value,
       round(avg(ln(n)) + regr_slope(ln(n), k / 10.0::DOUBLE) * avg(k / 10.0::DOUBLE), 6) AS a_value,
       2.0::DOUBLE AS completeness_magnitude, (SELECT count(mag) FROM quakes) AS total_events
FROM bins WHERE k >= 20""", live=True)
def _(spark, sf_dir):
    fit = results.gr_section(_live_summary(spark, sf_dir))
    return fit.withColumns({c: F.round(c, 6) for c in ("b_value", "a_value")})


@check("inc_risk", SPAN_SQL + f"SELECT {RISK_COLUMNS_SQL}, total AS total_events FROM base", live=True)
def _(spark, sf_dir):
    return portable_risk(results.risk_section(_live_summary(spark, sf_dir)))


@check("stream_counters", """
SELECT count(*) AS total_events, epoch_us(max(lastupdate)) AS last_updated_us,
       count(*) * 500 AS memory_usage_estimate FROM quakes""", live=True)
def _(spark, sf_dir):
    return results.data_stats(_live_summary(spark, sf_dir))


@check("inc_disorder_magnitude", HISTOGRAM_SQL, catalogue=DISORDER_SQL)
def _(spark, sf_dir):
    # Late versions that lose, one that wins a tie, events of long ago and far ahead.
    return results.magnitude_distribution(_followed(spark, _disordered(spark, sf_dir)))


@check("inc_disorder_risk", SPAN_SQL + f"SELECT {RISK_COLUMNS_SQL}, total AS total_events FROM base", catalogue=DISORDER_SQL)
def _(spark, sf_dir):
    return portable_risk(results.risk_section(_followed(spark, _disordered(spark, sf_dir))))


@check("inc_disorder_hotspots", HOTSPOTS_SQL, catalogue=DISORDER_SQL)
def _(spark, sf_dir):
    return results.region_hotspots(_followed(spark, _disordered(spark, sf_dir)))


@check("inc_disorder_counters", """
SELECT count(*) AS total_events, epoch_us(max(lastupdate)) AS last_updated_us,
       count(*) * 500 AS memory_usage_estimate FROM quakes""", catalogue=DISORDER_SQL)
def _(spark, sf_dir):
    return results.data_stats(_followed(spark, _disordered(spark, sf_dir)))


@check("stream_store", f"SELECT {ROWS_SQL} FROM quakes", catalogue=DISORDER_SQL)
def _(spark, sf_dir):
    # The events that the log's store holds are its newest versions.
    root = _disordered(spark, sf_dir)
    _followed(spark, root)
    return rows(read_store(spark, Store(f"{root}/store")))


PARTS_SQL = """
WITH p AS (
  SELECT 'magnitude' AS processor, count(*) AS n FROM quakes GROUP BY k
  UNION ALL SELECT 'calendar', count(*) FROM quakes GROUP BY CAST(time AS DATE), hour(time)
  UNION ALL SELECT 'region', count(*) FROM quakes GROUP BY flynn_region
  UNION ALL SELECT 'grid', count(*) FROM quakes GROUP BY round(lat * 2), round(lon * 2))
SELECT processor, count(*) AS groups, CAST(sum(n) AS BIGINT) AS events FROM p GROUP BY 1"""


def _parts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("processor").agg(
        F.count("*").alias("groups"), F.sum("n").alias("events")
    )


@check("batch_fan_out", PARTS_SQL)
def _(spark, sf_dir):
    return _parts(_streamed_summary(spark, sf_dir))


@check("recompute_all", PARTS_SQL)
def _(spark, sf_dir):
    path = new_work_folder(spark, "recompute")
    results.recompute_all(read_quakes(spark, sf_dir), path)
    return _parts(results.read_summary(spark, path))


@check("processors", """
SELECT magtype, count(*) AS n, count(*) FILTER (WHERE mag IS NOT NULL) AS n_mag FROM quakes
GROUP BY 1""")
def _(spark, sf_dir):
    # A processor of the user's own, stored and read back.
    by_type = Processor("magtype", {"magtype": lambda: F.col("magtype")})
    path = new_work_folder(spark, "processors")
    results.recompute_all(read_quakes(spark, sf_dir), path, (by_type,))
    summary = results.read_summary(spark, path, (by_type,))
    return part(summary, by_type).select("magtype", "n", "n_mag")


@check("processors_stream", """
SELECT magtype, count(*) AS n, count(*) FILTER (WHERE mag IS NOT NULL) AS n_mag FROM quakes
GROUP BY 1""")
def _(spark, sf_dir):
    by_type = Processor("magtype", {"magtype": lambda: F.col("magtype")})
    root = _once(spark, "own", sf_dir, lambda root: incremental.start_summaries(
        _stored_stream(spark, sf_dir), f"{root}/partial", f"{root}/checkpoint", processors=(by_type,)
    ))
    summary = results.read_summary(spark, f"{root}/partial", (by_type,))
    return part(summary, by_type).select("magtype", "n", "n_mag")


LARGEST = largest("largest", {"flynn_region": lambda: F.col("flynn_region")}, 3)
DAYS = active_days("days", {"magtype": lambda: F.col("magtype")})
LARGEST_SQL = """
SELECT flynn_region, place, mag, unid FROM (
  SELECT *, row_number() OVER (PARTITION BY flynn_region ORDER BY mag DESC, unid) AS place
  FROM quakes WHERE mag IS NOT NULL)
WHERE place <= 3"""
DAYS_SQL = """
WITH d AS (SELECT DISTINCT magtype, CAST(time AS DATE) AS day FROM quakes WHERE time IS NOT NULL),
runs AS (SELECT magtype, day - CAST(row_number() OVER (PARTITION BY magtype ORDER BY day) AS INTEGER) AS run FROM d),
sizes AS (SELECT magtype, run, count(*) AS n FROM runs GROUP BY 1, 2)
SELECT magtype, CAST(sum(n) AS BIGINT) AS days, max(n) AS longest FROM sizes GROUP BY 1"""


def _largest(states: DataFrame) -> DataFrame:
    ranked = state_results(states, LARGEST).select("flynn_region", F.posexplode("result").alias("at", "e"))
    return ranked.select("flynn_region", (F.col("at") + 1).cast("bigint").alias("place"), "e.mag", "e.unid")


def _days(states: DataFrame) -> DataFrame:
    return state_results(states, DAYS).select("magtype", "result.days", "result.longest")


def _streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _once(spark, "states", sf_dir, lambda root: incremental.start_states(
        _stored_stream(spark, sf_dir), f"{root}/partial", f"{root}/checkpoint", (LARGEST, DAYS)
    ))
    return incremental.read_states(spark, f"{root}/partial", (LARGEST, DAYS))


def _followed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a store that follows a log with updates, batch by batch."""
    root = _disordered(spark, sf_dir)
    store = Store(f"{root}/store_of_states", states=(LARGEST, DAYS))
    for batch in sorted(int(p.rsplit("=", 1)[1]) for p in paths_like(spark, f"{root}/versions/batch_id=*")):
        incremental.follow_log(spark, root, store, upto=batch)
    return read_store_states(spark, store)


@check("own_state", LARGEST_SQL)
def _(spark, sf_dir):
    return _largest(summarize_states(read_quakes(spark, sf_dir), (LARGEST, DAYS)))


@check("own_state_days", DAYS_SQL)
def _(spark, sf_dir):
    return _days(summarize_states(read_quakes(spark, sf_dir), (LARGEST, DAYS)))


@check("own_state_stream", LARGEST_SQL)
def _(spark, sf_dir):
    return _largest(_streamed_states(spark, sf_dir))


@check("own_state_days_stream", DAYS_SQL)
def _(spark, sf_dir):
    return _days(_streamed_states(spark, sf_dir))


@check("own_state_store", LARGEST_SQL, catalogue=DISORDER_SQL)
def _(spark, sf_dir):
    # Replaced versions leave the three largest again, which no merge could take back.
    return _largest(_followed_states(spark, sf_dir))
