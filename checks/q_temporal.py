"""Activity per calendar unit."""

from pyspark.sql import functions as F

from checks.registry import check
from temblor.functions import calendar as c
from temblor.operators import temporal as t
from temblor.operators.filters import add_time_parts
from temblor.sources.quakes import read_quakes

DAILY_SQL = """SELECT CAST(CAST(time AS DATE) AS VARCHAR) AS date, count(*) AS count
FROM quakes GROUP BY 1"""
HOURLY_SQL = "SELECT hour(time)::BIGINT AS hour, count(*) AS count FROM quakes GROUP BY 1"
MONTHLY_SQL = "SELECT month(time)::BIGINT AS month, count(*) AS count FROM quakes GROUP BY 1"
WEEKLY_SQL = """
WITH spine(i, weekday) AS (VALUES (1, 'Mon'), (2, 'Tue'), (3, 'Wed'), (4, 'Thu'), (5, 'Fri'),
                                  (6, 'Sat'), (7, 'Sun'))
SELECT s.weekday, count(q.unid) AS count
FROM spine s LEFT JOIN quakes q ON isodow(q.time) = s.i GROUP BY s.weekday"""


@check("daily_counts", DAILY_SQL)
def _(spark, sf_dir):
    return t.daily_counts(read_quakes(spark, sf_dir))


@check("hourly_frequency", HOURLY_SQL)
def _(spark, sf_dir):
    return t.hourly_frequency(read_quakes(spark, sf_dir))


@check("monthly_frequency", MONTHLY_SQL)
def _(spark, sf_dir):
    return t.monthly_frequency(read_quakes(spark, sf_dir))


@check("weekly_frequency", WEEKLY_SQL)
def _(spark, sf_dir):
    return t.weekly_frequency(read_quakes(spark, sf_dir))


@check("weekday_spine", """
WITH spine(i, weekday) AS (VALUES (1, 'Mon'), (2, 'Tue'), (3, 'Wed'), (4, 'Thu'), (5, 'Fri'),
                                  (6, 'Sat'), (7, 'Sun')),
weekend AS (SELECT time FROM quakes WHERE isodow(time) >= 6)
SELECT s.weekday, count(q.time) AS count
FROM spine s LEFT JOIN weekend q ON isodow(q.time) = s.i GROUP BY s.weekday""")
def _(spark, sf_dir):
    # Weekend activity only, so that five days must be filled in.
    quakes = read_quakes(spark, sf_dir).filter(c.utc_weekday(F.col("time")) >= 5)
    return t.weekly_frequency(quakes)


@check("temporal_section", """
SELECT CAST(CAST(time AS DATE) AS VARCHAR) AS date, count(*) AS daily_count
FROM quakes GROUP BY 1""")
def _(spark, sf_dir):
    return t.temporal_section(read_quakes(spark, sf_dir))


@check("month_name", """
SELECT strftime(min(time), '%b') AS month_name, month(time)::BIGINT AS month, count(*) AS count
FROM quakes GROUP BY month(time)""")
def _(spark, sf_dir):
    return t.with_month_names(t.monthly_frequency(read_quakes(spark, sf_dir)))


@check("add_time_parts", """
SELECT unid, CAST(CAST(time AS DATE) AS VARCHAR) AS date, hour(time)::BIGINT AS hour,
       month(time)::BIGINT AS month FROM quakes""")
def _(spark, sf_dir):
    return add_time_parts(read_quakes(spark, sf_dir)).select("unid", "date", "hour", "month")


@check("date_parts", """
SELECT unid, CAST(CAST(time AS DATE) AS VARCHAR) AS date, hour(time)::BIGINT AS hour,
       month(time)::BIGINT AS month, isodow(time)::BIGINT - 1 AS weekday FROM quakes""")
def _(spark, sf_dir):
    time = F.col("time")
    return read_quakes(spark, sf_dir).select(
        "unid",
        c.utc_date(time).alias("date"),
        c.utc_hour(time).alias("hour"),
        c.utc_month(time).alias("month"),
        c.utc_weekday(time).alias("weekday"),
    )


@check("weekday_name", "SELECT unid, strftime(time, '%a') AS weekday FROM quakes")
def _(spark, sf_dir):
    weekday = c.weekday_name(c.utc_weekday(F.col("time")))
    return read_quakes(spark, sf_dir).select("unid", weekday.alias("weekday"))


@check("timestamp_parse", """
SELECT e.event_id AS id, epoch_us(e.ts) AS parsed_us FROM events e""")
def _(spark, sf_dir):
    # The times as RFC 3339 text, written by another program, read back.
    text = F.concat(F.col("ts").cast("string"), F.lit("Z"))
    events = spark.read.schema("event_id BIGINT, ts TIMESTAMP_NTZ").parquet(
        f"{sf_dir}/events.parquet"
    )
    iso = F.regexp_replace(text, " ", "T")
    return events.select(
        F.col("event_id").alias("id"), c.parse_timestamp(iso).alias("parsed")
    )
