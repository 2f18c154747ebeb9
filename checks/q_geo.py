"""Regions and grid cells."""

from pyspark.sql import functions as F

from checks.registry import check, rounded
from temblor.functions.geo import grid_half_degree
from temblor.operators import geo as g
from temblor.operators.filters import map_clusters
from temblor.sources.quakes import read_quakes

HOTSPOTS_SQL = "SELECT flynn_region, count(*) AS count FROM quakes GROUP BY 1"
CLUSTERS_SQL = """
SELECT round(lat * 2) / 2 + 0.0 AS lat, round(lon * 2) / 2 + 0.0 AS lon, count(*) AS count
FROM quakes GROUP BY 1, 2"""
TOP_SQL = """
SELECT flynn_region, count(*) AS event_count, round(avg(mag), 6) AS avg_magnitude,
       round(avg(depth), 6) AS avg_depth
FROM quakes GROUP BY 1 ORDER BY event_count DESC, flynn_region LIMIT 10"""


@check("region_hotspots", HOTSPOTS_SQL)
def _(spark, sf_dir):
    return g.region_hotspots(read_quakes(spark, sf_dir))


@check("coordinate_clusters", CLUSTERS_SQL)
def _(spark, sf_dir):
    return g.coordinate_clusters(read_quakes(spark, sf_dir))


@check("map_clusters", f"WITH cells AS ({CLUSTERS_SQL}) SELECT * FROM cells WHERE abs(lat) < 70")
def _(spark, sf_dir):
    return map_clusters(g.coordinate_clusters(read_quakes(spark, sf_dir)))


@check("grid_half_degree", """
SELECT unid, round(lat * 2) / 2 + 0.0 AS lat, round(lon * 2) / 2 + 0.0 AS lon FROM quakes""")
def _(spark, sf_dir):
    return read_quakes(spark, sf_dir).select(
        "unid",
        grid_half_degree(F.col("lat")).alias("lat"),
        grid_half_degree(F.col("lon")).alias("lon"),
    )


@check("hotspot_section", f"WITH top AS ({TOP_SQL}) SELECT * EXCLUDE (avg_depth) FROM top")
def _(spark, sf_dir):
    return rounded(g.hotspot_section(read_quakes(spark, sf_dir)), "avg_magnitude")


@check("regional_analysis", TOP_SQL)
def _(spark, sf_dir):
    return rounded(g.regional_analysis(read_quakes(spark, sf_dir)), "avg_magnitude", "avg_depth")


@check("top_regions", """
SELECT flynn_region, count(*) AS event_count FROM quakes GROUP BY 1
ORDER BY event_count DESC, flynn_region LIMIT 10""")
def _(spark, sf_dir):
    stats = g.region_stats(read_quakes(spark, sf_dir)).select("flynn_region", "event_count")
    return g.top_regions(stats)


@check("region_rank", """
WITH c AS (SELECT flynn_region, count(*) AS event_count FROM quakes GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY event_count DESC, flynn_region) AS rank FROM c
QUALIFY rank <= 10""")
def _(spark, sf_dir):
    return g.region_rank(read_quakes(spark, sf_dir))


@check("region_pie", """
WITH c AS (SELECT flynn_region, count(*) AS n FROM quakes GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, flynn_region) AS rank FROM c)
SELECT CASE WHEN rank <= 10 THEN flynn_region ELSE 'Others' END AS name,
       CAST(sum(n) AS BIGINT) AS value FROM r GROUP BY 1""")
def _(spark, sf_dir):
    return g.region_pie(read_quakes(spark, sf_dir))
