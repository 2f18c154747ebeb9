import json
import math

import pytest
from pyspark.sql import functions as F

from helpers import utc
from temblor.plans.report import SECTION_TITLES, advanced_analytics, report_json, section_json
from temblor.plans.processors import Processor
from temblor.sources.geojson import empty_events


def data(report):
    return {r["title"]: json.loads(r["data"]) for r in report.orderBy("seq").collect()}


def test_report(make):
    events = make(
        mag=[2.0, 3.0, 4.0], depth=[10.0, 20.0, 60.0], flynn_region=["B", "A", "B"],
        time=[utc(2024, 1, 1), utc(2024, 1, 1, 12), utc(2024, 1, 3)],
    )
    report = advanced_analytics(events)
    sections = data(report)
    assert tuple(sections) == SECTION_TITLES
    assert sections["Magnitude Statistics"] == {
        "mean_magnitude": 3.0, "median_magnitude": 3.0, "std_magnitude": 1.0,
        "min_magnitude": 2.0, "max_magnitude": 4.0,
    }
    assert sections["Temporal Patterns Analysis"] == [
        {"date": "2024-01-01", "daily_count": 2}, {"date": "2024-01-03", "daily_count": 1}
    ]
    assert sections["Depth Statistics"]["median_depth"] == 20.0
    assert sections["Geographic Hotspots"] == [
        {"flynn_region": "B", "event_count": 2, "avg_magnitude": 3.0},
        {"flynn_region": "A", "event_count": 1, "avg_magnitude": 3.0},
    ]
    assert sections["Gutenberg-Richter Analysis"] == {
        "b_value": 0.0, "a_value": 0.0, "completeness_magnitude": 2.0, "total_events": 3
    }
    risk = sections["Risk Assessment"]
    assert risk["prob_mag5_30days"] == 0.0 and risk["total_events"] == 3
    assert math.log10(risk["total_energy_joules"]) == pytest.approx(
        math.log10(sum(10 ** (11.8 + 1.5 * m) for m in (2, 3, 4)))
    )
    assert sections["Regional Analysis"][0] == {
        "flynn_region": "B", "event_count": 2, "avg_magnitude": 3.0, "avg_depth": 35.0
    }
    whole = json.loads(report_json(report).first()["report"])
    assert [s["title"] for s in whole["stats"]] == list(SECTION_TITLES)
    assert whole["stats"][6]["data"] == sections["Regional Analysis"]


def test_report_of_one_event_has_objects(make):
    sections = data(advanced_analytics(make({})))
    assert all(isinstance(s, dict) for s in sections.values())
    assert sections["Temporal Patterns Analysis"] == {"date": "2023-03-14", "daily_count": 1}


def test_report_of_nothing(spark):
    sections = data(advanced_analytics(empty_events(spark)))
    assert sections["Geographic Hotspots"] == {} and sections["Temporal Patterns Analysis"] == {}
    assert sections["Magnitude Statistics"]["mean_magnitude"] is None
    assert sections["Gutenberg-Richter Analysis"]["b_value"] == 1.0
    assert sections["Risk Assessment"]["total_events"] == 0


def test_report_skips_nothing_in_a_list_of_many_regions(make):
    events = make(flynn_region=[f"r{i:02d}" for i in range(15)] + [None] * 3)
    hot = data(advanced_analytics(events))["Geographic Hotspots"]
    assert [h["flynn_region"] for h in hot] == [None] + [f"r{i:02d}" for i in range(9)]


def test_section_json_escapes(spark):
    table = spark.createDataFrame([('say "hi"', 1), ("b", 2)], "name STRING, n INT")
    text = section_json(table, F.col("n")).first()["data"]
    assert json.loads(text) == [{"name": 'say "hi"', "n": 1}, {"name": "b", "n": 2}]


def test_own_section(make):
    def by_type(counts):
        return counts.select("magtype", "n")

    kind = Processor("kind", {"magtype": lambda: F.col("magtype")}, "Magnitude Types", by_type)
    sections = data(advanced_analytics(make(magtype=["mw", "ml", "mw"]), extra=(kind,)))
    assert tuple(sections) == (*SECTION_TITLES, "Magnitude Types")
    assert sections["Magnitude Types"] == [{"magtype": "ml", "n": 1}, {"magtype": "mw", "n": 2}]
