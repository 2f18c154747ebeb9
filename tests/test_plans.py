"""What the physical plans must look like to hold up on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from helpers import utc
from temblor.operators import filters, geo, magnitude, risk, stats, temporal
from temblor.operators.query import QueryParams, constrain
from temblor.plans.processors import summarize
from temblor.sources import geojson, messages
from temblor.sources.quakes import read_quakes

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def formatted(frame):
    utils = frame.sparkSession.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(frame._jdf.queryExecution(), "formatted")


def scan_detail(frame, file, label):
    """One line of the detail of the scan of ``file`` in the formatted plan."""
    for block in formatted(frame).split("\n\n"):
        if "Scan parquet" in block and file in block:
            return re.search(rf"{label}: (.*)", block).group(1)
    raise AssertionError(f"no scan of {file}")


def scanned(frame):
    """Columns that the scan of the events table reads."""
    schema = scan_detail(frame, "events.parquet", "ReadSchema")
    return {field.split(":")[0] for field in schema.removeprefix("struct<").rstrip(">").split(",")}


@pytest.fixture(scope="module")
def quakes(spark):
    return read_quakes(spark, DATA)


def test_no_join_without_region(quakes):
    assert "Join" not in plan(magnitude.magnitude_counts(quakes))
    assert "BroadcastHashJoin" in plan(geo.region_hotspots(quakes))


@pytest.mark.parametrize("operator,columns", [
    (magnitude.magnitude_distribution, {"value"}),
    (magnitude.gr_fit, {"value"}),
    (temporal.weekly_frequency, {"ts"}),
    (risk.risk_metrics, {"ts", "value"}),
    (stats.magnitude_stats, {"value"}),
    (geo.coordinate_clusters, {"user_id", "props"}),
    (summarize, {"event_id", "ts", "user_id", "value", "props"}),
])
def test_scans_read_only_what_they_need(quakes, operator, columns):
    assert scanned(operator(quakes)) == columns


def test_time_range_reaches_the_scan(quakes):
    part = filters.events_in_range(quakes, utc(2024, 1, 5), utc(2024, 1, 6))
    pushed = scan_detail(part, "events.parquet", "PushedFilters")
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed


def test_stored_table_filters_reach_the_scan(spark, make, tmp_path):
    from temblor.sources.event_table import read_events, write_events

    path = str(tmp_path / "t")
    write_events(make({}), path)
    params = QueryParams(lat=10.0, lon=20.0, maxradius=5000.0, minmag=2.0, catalog="X")
    pushed = scan_detail(constrain(read_events(spark, path), params), path, "PushedFilters")
    for column in ("lat", "lon", "mag", "source_catalog"):
        assert column in pushed


def scans(frame):
    return plan(frame).count("FileScan parquet")


@pytest.mark.parametrize("operator", [
    magnitude.magnitude_frequency, magnitude.gr_section, risk.risk_section,
    temporal.weekly_frequency, temporal.temporal_section,
])
def test_one_scan(quakes, operator):
    assert scans(operator(quakes)) == 1


def test_summary_is_one_scan_of_events_and_one_of_nations(quakes):
    assert scans(summarize(quakes)) == 2


def test_no_python_in_operators(quakes):
    for frame in (summarize(quakes), stats.magnitude_stats(quakes), geo.region_pie(quakes)):
        assert "Python" not in plan(frame) and "CartesianProduct" not in plan(frame)


def test_texts_are_parsed_once(spark):
    lines = spark.createDataFrame([("{}",)], "value STRING")
    strict = geojson.require_all(geojson.parse_features(lines, "value"), "value")
    assert plan(strict).count("from_json") == 1
    assert plan(messages.accepted(messages.parse_messages(lines))).count("from_json") == 1


def test_events_are_combined_before_the_shuffle(quakes):
    for frame in (
        magnitude.magnitude_counts(quakes), geo.coordinate_clusters(quakes), summarize(quakes),
    ):
        text = plan(frame)
        exchange = text.index("Exchange hashpartitioning")
        assert "partial_count" in text[exchange:]


def test_statistics_read_the_events_once_more_than_the_medians(spark, make, tmp_path):
    from temblor.sources.event_table import read_events, write_events

    path = str(tmp_path / "t")
    write_events(make(mag=[1.0, 2.0, 2.5], depth=[1.0, 5.0, 9.0]), path)
    result = stats.column_stats(read_events(spark, path), "mag", "depth")
    assert {r["column"]: r["median"] for r in result.collect()} == {"mag": 2.0, "depth": 5.0}
    # What is left is the moments; no value is shuffled.
    text = plan(result).split("== Initial Plan ==")[0]
    assert text.count("FileScan parquet") == 1
    assert not [line for line in text.split("\n") if "Exchange hashpartitioning" in line and "value" in line]


@pytest.mark.parametrize("operator", [geo.region_pie])
def test_branches_share_one_scan(spark, make, tmp_path, operator):
    """Counts that are used more than once come from one exchange."""
    from temblor.sources.event_table import read_events, write_events

    path = str(tmp_path / "t")
    write_events(make(mag=[1.0, 2.0, 2.5], depth=[1.0, 5.0, 9.0]), path)
    result = operator(read_events(spark, path))
    result.collect()
    final = plan(result).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_dates_are_pruned_for_time_filters(spark, make, tmp_path):
    from temblor.operators import ordering, retention
    from temblor.sources.event_table import read_events, write_events

    path = str(tmp_path / "t")
    write_events(make(time=[utc(2024, 1, d) for d in range(1, 11)]), path)
    events = read_events(spark, path, with_date=True)
    params = QueryParams(start=utc(2024, 1, 9), end=utc(2024, 1, 10))
    for frame, rows in (
        (filters.events_in_range(events, utc(2024, 1, 4), utc(2024, 1, 5)), 2),
        (retention.retention_keep(events, utc(2024, 1, 8)), 3),
        (constrain(events, params), 2),
    ):
        assert "event_date" in scan_detail(frame, path, "PartitionFilters")
        assert frame.count() == rows
    before = ordering.SHORT_LIST
    ordering.SHORT_LIST = 1
    try:
        newest = ordering.newest_events(events, 3)
        assert "event_date" in scan_detail(newest, path, "PartitionFilters")
        assert sorted(r["unid"] for r in newest.collect()) == ["test_7", "test_8", "test_9"]
        second_page = ordering.page(events, "time", 2, 2)
        assert [r["unid"] for r in second_page.collect()] == ["test_7", "test_6"]
    finally:
        ordering.SHORT_LIST = before


def rows_read(frame):
    """Rows that the scans of a finished query handed on."""
    frame.collect()
    total, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_box_reads_a_small_part_of_a_table_laid_out_by_place(spark, tmp_path):
    from temblor.schema import EVENT_COLUMNS, EVENT_SCHEMA
    from temblor.sources.event_table import read_events, write_events

    n = 200_000
    mixed = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double") / 1_000_003
    wide = {"unid": F.col("id").cast("string"), "time": F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id")),
            "lat": mixed * 180 - 90, "lon": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)).cast("double") / 1_000_003 * 360 - 180}
    events = spark.range(n).select(*[
        wide.get(c, F.lit(None)).cast(EVENT_SCHEMA[c].dataType).alias(c) for c in EVENT_COLUMNS])
    read = {}
    for layout in ("time", "place"):
        write_events(events, str(tmp_path / layout), layout=layout)
        table = read_events(spark, str(tmp_path / layout))
        params = QueryParams(lat=38.0, lon=22.0, maxradius=300_000)
        circle = constrain(table, params)
        read[layout] = rows_read(circle), sorted(r["unid"] for r in circle.collect())
    assert read["time"][1] == read["place"][1] and len(read["place"][1]) > 10
    assert read["time"][0] > n / 2 and read["place"][0] < n / 2


def test_magtype_reaches_the_scan(spark, make, tmp_path):
    from temblor.sources.event_table import read_events, write_events

    path = str(tmp_path / "t")
    write_events(make(magtype=["mb", "MB", "Mb", "mw", None, "mbb"]), path)
    found = constrain(read_events(spark, path), QueryParams(magtype="mB"))
    assert "In(magtype" in scan_detail(found, path, "PushedFilters")
    assert sorted(r["magtype"] for r in found.collect()) == ["MB", "Mb", "mb"]
