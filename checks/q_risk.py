"""Probabilities, energy and the statistics sections."""

from pyspark.sql import functions as F

from checks.registry import check, rounded
from temblor.functions.magnitude import magnitude_to_energy, mag_bucket, mag_key
from temblor.functions.risk import poisson_exceedance
from temblor.operators import risk as r, stats as s
from temblor.sources.quakes import read_quakes

SPAN_SQL = """
WITH base AS (
  SELECT CASE WHEN max(time) > min(time)
              THEN (epoch_us(max(time)) - epoch_us(min(time))) / 86400000000.0::DOUBLE
              ELSE 1.0 END AS span,
         CAST(count(*) FILTER (WHERE k >= 50) AS DOUBLE) AS n5,
         CAST(count(*) FILTER (WHERE k >= 60) AS DOUBLE) AS n6,
         CAST(count(*) FILTER (WHERE k >= 70) AS DOUBLE) AS n7,
         coalesce(sum(pow(10, 11.8 + 1.5 * mag)), 0) AS energy,
         count(mag) AS total
  FROM quakes)
"""
RISK_COLUMNS_SQL = """
round(1 - exp(-n5 / span * 30), 9) AS prob_mag5_30days,
round(1 - exp(-n6 / span * 365), 9) AS prob_mag6_365days,
round(1 - exp(-n7 / span * 365), 9) AS prob_mag7_365days,
round(log10(energy), 9) AS total_energy_joules"""
PROBABILITIES = tuple(r.STANDARD_RISKS)


def portable_risk(section):
    """Energy as its logarithm: the last digits of the sum depend on the order of addition."""
    return rounded(
        section.withColumn("total_energy_joules", F.log10("total_energy_joules")),
        *PROBABILITIES, "total_energy_joules", places=9,
    )


@check("events_at_least", "SELECT count(*) AS count FROM quakes WHERE k >= 50")
def _(spark, sf_dir):
    return r.events_at_least(read_quakes(spark, sf_dir), 5.0)


@check("time_span_days", SPAN_SQL + "SELECT round(span, 9) AS time_span_days FROM base")
def _(spark, sf_dir):
    return rounded(r.time_span_days(read_quakes(spark, sf_dir)), "time_span_days", places=9)


# A rare event within one day, so that the probability is not close to 1.
@check("exceedance_probability", SPAN_SQL + """
SELECT round(1 - exp(-n7 / span * 1), 9) AS probability FROM base""")
def _(spark, sf_dir):
    chance = r.exceedance_probability(read_quakes(spark, sf_dir), 7.0, 1.0)
    return rounded(chance, "probability", places=9)


@check("poisson_exceedance", """
SELECT unid, round(1 - exp(-mag / 10), 9) AS probability FROM quakes""")
def _(spark, sf_dir):
    chance = poisson_exceedance(F.col("mag") / 10)
    return read_quakes(spark, sf_dir).select("unid", F.round(chance, 9).alias("probability"))


@check("total_energy", SPAN_SQL + "SELECT round(log10(energy), 9) AS log_energy FROM base")
def _(spark, sf_dir):
    energy = r.total_energy(read_quakes(spark, sf_dir))
    return energy.select(F.round(F.log10("total_energy"), 9).alias("log_energy"))


@check("energy_tnt", SPAN_SQL + """
SELECT round(log10(energy / 4.184e9), 9) AS log_tnt_tons,
       round(log10(energy / 4.184e9 / 1e12), 9) AS log_tnt_scaled FROM base""")
def _(spark, sf_dir):
    return r.energy_in_tnt(read_quakes(spark, sf_dir)).select(
        F.round(F.log10("tnt_tons"), 9).alias("log_tnt_tons"),
        F.round(F.log10("tnt_scaled"), 9).alias("log_tnt_scaled"),
    )


@check("risk_metrics", SPAN_SQL + f"SELECT {RISK_COLUMNS_SQL} FROM base")
def _(spark, sf_dir):
    return portable_risk(r.risk_metrics(read_quakes(spark, sf_dir)))


@check("risk_section", SPAN_SQL + f"SELECT {RISK_COLUMNS_SQL}, total AS total_events FROM base")
def _(spark, sf_dir):
    return portable_risk(r.risk_section(read_quakes(spark, sf_dir)))


@check("risk_level", SPAN_SQL + """, p AS (SELECT 1 - exp(-n6 / span * 365) AS p FROM base)
SELECT round(p, 9) AS probability,
       CASE WHEN p > 0.1 THEN 'High' WHEN p > 0.05 THEN 'Moderate' ELSE 'Low' END AS risk_level,
       CASE WHEN p > 0.1 THEN 'Increased likelihood of significant earthquakes'
            WHEN p > 0.05 THEN 'Potential for moderate earthquakes'
            ELSE 'Low likelihood of significant earthquakes' END AS sentence
FROM p""")
def _(spark, sf_dir):
    return rounded(r.risk_reading(read_quakes(spark, sf_dir)), "probability", places=9)


@check("magnitude_to_energy", """
SELECT unid, round(log10(pow(10, 11.8 + 1.5 * mag)), 9) AS log_energy FROM quakes""")
def _(spark, sf_dir):
    log_energy = F.log10(magnitude_to_energy(F.col("mag")))
    return read_quakes(spark, sf_dir).select("unid", F.round(log_energy, 9).alias("log_energy"))


@check("mag_key", "SELECT unid, k AS mag_key FROM quakes")
def _(spark, sf_dir):
    return read_quakes(spark, sf_dir).select("unid", mag_key(F.col("mag")).alias("mag_key"))


@check("mag_bucket", "SELECT unid, k - k % 2 AS bucket FROM quakes")
def _(spark, sf_dir):
    bucket = mag_bucket(mag_key(F.col("mag")))
    return read_quakes(spark, sf_dir).select("unid", bucket.alias("bucket"))


def _stats_sql(column: str, suffix: str) -> str:
    return f"""
SELECT round(avg({column}), 6) AS mean_{suffix}, round(median({column}), 6) AS median_{suffix},
       round(stddev_samp({column}), 6) AS std_{suffix}, min({column}) AS min_{suffix},
       max({column}) AS max_{suffix} FROM quakes"""


@check("magnitude_stats", _stats_sql("mag", "magnitude"))
def _(spark, sf_dir):
    return rounded(
        s.magnitude_stats(read_quakes(spark, sf_dir)),
        "mean_magnitude", "median_magnitude", "std_magnitude",
    )


@check("depth_stats", _stats_sql("depth", "depth"))
def _(spark, sf_dir):
    return rounded(
        s.depth_stats(read_quakes(spark, sf_dir)), "mean_depth", "median_depth", "std_depth"
    )


@check("data_stats", """
SELECT count(*) AS total_events, epoch_us(max(lastupdate)) AS last_updated_us,
       count(*) * 500 AS memory_usage_estimate FROM quakes""")
def _(spark, sf_dir):
    return s.data_stats(read_quakes(spark, sf_dir))
