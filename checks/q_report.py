"""The report and its JSON forms."""

from pyspark.sql import functions as F

from checks.q_geo import TOP_SQL
from checks.q_magnitude import FIT_SQL
from checks.q_risk import SPAN_SQL
from checks.registry import check
from temblor.plans.report import advanced_analytics, report_json
from temblor.sources.quakes import read_quakes


def _wide(title: str, label: str, table: str, metrics: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{title}' AS title, {label} AS label, '{metric}' AS metric, {sql} AS value FROM {table}"
        for metric, sql in metrics.items()
    )


def _stats(column: str, suffix: str) -> dict[str, str]:
    return {
        f"mean_{suffix}": f"avg({column})",
        f"median_{suffix}": f"median({column})",
        f"std_{suffix}": f"stddev_samp({column})",
        f"min_{suffix}": f"min({column})",
        f"max_{suffix}": f"max({column})",
    }


_VALUES = [
    _wide("Magnitude Statistics", "''", "quakes", _stats("mag", "magnitude")),
    "SELECT 'Temporal Patterns Analysis', CAST(CAST(time AS DATE) AS VARCHAR), 'daily_count', "
    "count(*)::DOUBLE FROM quakes GROUP BY CAST(time AS DATE)",
    _wide("Depth Statistics", "''", "quakes", _stats("depth", "depth")),
    _wide("Geographic Hotspots", "flynn_region", "top",
          {c: f"{c}::DOUBLE" for c in ("event_count", "avg_magnitude")}),
    _wide("Gutenberg-Richter Analysis", "''", "fit", {
        "b_value": "b", "a_value": "a", "completeness_magnitude": "2.0::DOUBLE",
        "total_events": "(SELECT count(mag)::DOUBLE FROM quakes)",
    }),
    _wide("Risk Assessment", "''", "base", {
        "prob_mag5_30days": "1 - exp(-n5 / span * 30)",
        "prob_mag6_365days": "1 - exp(-n6 / span * 365)",
        "prob_mag7_365days": "1 - exp(-n7 / span * 365)",
        "total_energy_joules": "log10(energy)",
        "total_events": "total::DOUBLE",
    }),
    _wide("Regional Analysis", "flynn_region", "top",
          {c: f"{c}::DOUBLE" for c in ("event_count", "avg_magnitude", "avg_depth")}),
]


_VALUES_SQL = (f"{FIT_SQL.rstrip()}, base AS {SPAN_SQL.split('base AS', 1)[1]}"
       f", top AS ({TOP_SQL}), v AS (" + "\nUNION ALL ".join(_VALUES) + ")\n"
       "SELECT title, label, metric, round(value, 6) AS value FROM v")


# The text of a double differs between engines, so both names hand out the values.
@check("advanced_analytics", _VALUES_SQL)
@check("advanced_analytics_values", _VALUES_SQL)
def _(spark, sf_dir):
    # Read the numbers back out of the JSON of every section.
    report = advanced_analytics(read_quakes(spark, sf_dir))
    text = F.when(F.col("data").startswith("{"), F.concat(F.lit("["), "data", F.lit("]"))).otherwise(
        F.col("data")
    )
    items = report.select(
        "title", F.explode(F.from_json(text, "array<map<string,string>>")).alias("item")
    )
    label = F.coalesce(F.col("item")["flynn_region"], F.col("item")["date"], F.lit(""))
    values = items.select("title", label.alias("label"), F.explode("item").alias("metric", "text"))
    number = F.col("text").cast("double")
    return values.filter(~F.col("metric").isin("flynn_region", "date")).select(
        "title", "label", "metric",
        F.round(
            F.when(F.col("metric") == "total_energy_joules", F.log10(number)).otherwise(number), 6
        ).alias("value"),
    )


@check("report_json", """
WITH d AS (SELECT count(DISTINCT CAST(time AS DATE)) AS days FROM quakes)
SELECT seq::BIGINT AS seq, title, CASE seq WHEN 2 THEN days WHEN 4 THEN 10 WHEN 7 THEN 10 ELSE 1 END::BIGINT
       AS items
FROM d, (VALUES (1, 'Magnitude Statistics'), (2, 'Temporal Patterns Analysis'),
         (3, 'Depth Statistics'), (4, 'Geographic Hotspots'), (5, 'Gutenberg-Richter Analysis'),
         (6, 'Risk Assessment'), (7, 'Regional Analysis')) AS t(seq, title)""")
def _(spark, sf_dir):
    text = report_json(advanced_analytics(read_quakes(spark, sf_dir)))
    stats = text.select(
        F.posexplode(
            F.from_json("report", "stats array<struct<title:string,data:string>>")["stats"]
        ).alias("position", "section")
    )
    return stats.select(
        (F.col("position") + 1).cast("bigint").alias("seq"),
        "section.title",
        F.coalesce(F.json_array_length("section.data"), F.lit(1)).cast("bigint").alias("items"),
    )
