"""Magnitude histogram, bins and fits."""

from pyspark.sql import functions as F

from checks.registry import check, rounded
from temblor.functions.magnitude import log10_cumulative, ln_count, mag_bucket
from temblor.functions.risk import b_value_interpretation
from temblor.operators import magnitude as m
from temblor.sources.quakes import read_quakes

HISTOGRAM_SQL = """
SELECT regexp_replace(CAST(b / 10.0::DOUBLE AS VARCHAR), '\\.0$', '') AS magnitude,
       CAST(n AS BIGINT) AS count
FROM (SELECT k - k % 2 AS b, count(*) AS n FROM quakes GROUP BY 1) ORDER BY b
"""


@check("magnitude_distribution", HISTOGRAM_SQL)
def _(spark, sf_dir):
    return m.magnitude_distribution(read_quakes(spark, sf_dir))


@check("bucket_order", """
SELECT CAST(row_number() OVER (ORDER BY b) AS BIGINT) AS position, b AS bucket
FROM (SELECT DISTINCT k - k % 2 AS b FROM quakes)
""")
def _(spark, sf_dir):
    from pyspark.sql import Window

    bars = m.magnitude_counts(read_quakes(spark, sf_dir)).select(
        mag_bucket(F.col("mag_key")).alias("bucket")
    ).distinct()
    position = F.row_number().over(Window.orderBy("bucket")).cast("bigint")
    return bars.select(position.alias("position"), "bucket")


@check("magnitude_counts", "SELECT k AS mag_key, count(*) AS n FROM quakes GROUP BY 1")
def _(spark, sf_dir):
    return m.magnitude_counts(read_quakes(spark, sf_dir))


BINS_SQL = """
WITH bins AS (SELECT k, count(*) AS n FROM quakes GROUP BY 1),
cum AS (SELECT k, n, CAST(sum(n) OVER (ORDER BY k DESC) AS BIGINT) AS c FROM bins)
"""


@check("magnitude_frequency", BINS_SQL + """
SELECT k / 10.0::DOUBLE AS magnitude, n AS count, c AS cumulative FROM cum""")
def _(spark, sf_dir):
    return m.magnitude_frequency(read_quakes(spark, sf_dir))


@check("cumulative_counts", BINS_SQL + "SELECT k AS mag_key, c AS cumulative FROM cum")
def _(spark, sf_dir):
    counts = m.magnitude_counts(read_quakes(spark, sf_dir))
    return m.cumulative_of(counts).select("mag_key", "cumulative")


@check("ln_count", BINS_SQL + "SELECT k AS mag_key, round(ln(n), 9) AS ln_n FROM bins")
def _(spark, sf_dir):
    counts = m.magnitude_counts(read_quakes(spark, sf_dir))
    return counts.select("mag_key", F.round(ln_count(F.col("n")), 9).alias("ln_n"))


@check("log10_cumulative", BINS_SQL + """
SELECT k AS mag_key, round(log10(c), 9) AS log_cumulative FROM cum""")
def _(spark, sf_dir):
    counts = m.cumulative_of(m.magnitude_counts(read_quakes(spark, sf_dir)))
    return counts.select(
        "mag_key", F.round(log10_cumulative(F.col("cumulative")), 9).alias("log_cumulative")
    )


# The sums written out, so that the oracle does not lean on the same regression function.
FIT_SQL = BINS_SQL.rstrip() + """,
pts AS (SELECT k / 10.0::DOUBLE AS m, ln(n) AS l FROM bins WHERE k >= 20),
s AS (SELECT CAST(count(*) AS DOUBLE) AS c, sum(m) AS sm, sum(l) AS sl, sum(m * l) AS sml,
             sum(m * m) AS smm FROM pts),
fit AS (
  SELECT CASE WHEN c >= 3 THEN (c * sml - sm * sl) / (c * smm - sm * sm) ELSE 1.0 END AS b,
         CASE WHEN c >= 3 THEN sl / c + (c * sml - sm * sl) / (c * smm - sm * sm) * sm / c
              ELSE 0.0 END AS a
  FROM s)
"""


@check("gr_fit", FIT_SQL + """
SELECT round(b, 6) AS b_value, round(a, 6) AS a_value, 2.0::DOUBLE AS completeness_magnitude
FROM fit""")
def _(spark, sf_dir):
    return rounded(m.gr_fit(read_quakes(spark, sf_dir)), "b_value", "a_value")


@check("b_value", FIT_SQL + "SELECT round(b, 6) AS b_value FROM fit")
def _(spark, sf_dir):
    return rounded(m.b_value(read_quakes(spark, sf_dir)), "b_value")


@check("a_value", FIT_SQL + "SELECT round(a, 6) AS a_value FROM fit")
def _(spark, sf_dir):
    return rounded(m.a_value(read_quakes(spark, sf_dir)), "a_value")


@check("completeness_magnitude", FIT_SQL + "SELECT 2.0::DOUBLE AS completeness_magnitude FROM fit")
def _(spark, sf_dir):
    return m.completeness_magnitude(read_quakes(spark, sf_dir))


@check("gr_section", FIT_SQL + """
SELECT round(b, 6) AS b_value, round(a, 6) AS a_value, 2.0::DOUBLE AS completeness_magnitude,
       (SELECT count(mag) FROM quakes) AS total_events
FROM fit""")
def _(spark, sf_dir):
    return rounded(m.gr_section(read_quakes(spark, sf_dir)), "b_value", "a_value")


PUBLISHED_SQL = BINS_SQL.rstrip() + """,
fit AS (SELECT -regr_slope(log10(c), k / 10.0::DOUBLE) AS b,
               regr_intercept(log10(c), k / 10.0::DOUBLE) AS a
        FROM cum WHERE k >= 20)
"""


@check("gr_fit_published", PUBLISHED_SQL + """
SELECT round(b, 6) AS b_value, round(a, 6) AS a_value, 2.0::DOUBLE AS completeness_magnitude
FROM fit""")
def _(spark, sf_dir):
    return rounded(m.gr_fit_published(read_quakes(spark, sf_dir)), "b_value", "a_value")


@check("b_value_interpretation", PUBLISHED_SQL + """
SELECT round(b, 6) AS b_value,
       CASE WHEN b < 0.8 THEN 'High stress environment - more large earthquakes expected'
            WHEN b > 1.2 THEN 'Low stress environment - small earthquakes dominate'
            ELSE 'Normal stress environment - typical earthquake distribution' END AS reading
FROM fit""")
def _(spark, sf_dir):
    fit = m.gr_fit_published(read_quakes(spark, sf_dir))
    reading = b_value_interpretation(F.col("b_value")).alias("reading")
    return rounded(fit.select("b_value", reading), "b_value")
