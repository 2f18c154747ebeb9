import json

import pytest
from pyspark.sql import functions as F

from helpers import BASE, tuples, utc
from temblor.schema import EVENT_COLUMNS, EVENT_SCHEMA
from temblor.sources import event_table, geojson, messages, nested


def feature(**properties):
    values = {
        "unid": "iceland-77", "mag": 2, "magtype": "mlw", "lat": 64.0625, "lon": -21.375, "depth": 7.5,
        "time": "2023-03-14T06:15:42.25Z", "lastupdate": "2023-03-14T07:01:05.50025Z", "auth": "OBS",
        "flynn_region": "REYKJANES", "evtype": "se", "source_catalog": "NORTH", "source_id": "r-4410",
    } | properties
    return {
        "type": "Feature",
        "geometry": {"type": "Point", "coordinates": [values["lon"], values["lat"], -7.5]},
        "id": str(values["unid"]),
        "properties": {k: v for k, v in values.items() if v is not ...},
    }


def collection(*features):
    return json.dumps(
        {"type": "FeatureCollection", "metadata": {"count": len(features)}, "features": features},
        indent=1,
    )


@pytest.fixture
def body(tmp_path):
    def write(text, name="body.json"):
        (tmp_path / name).write_text(text)
        return str(tmp_path)

    return write


def test_collection(spark, body):
    greece = feature(unid="g", flynn_region="GREECE", mag=3.1, lat=38.5, lon=22.1)
    path = body(collection(feature(), greece))
    events = geojson.to_event_table(geojson.read_feature_collection(spark, path))
    assert events.schema == EVENT_SCHEMA
    other, iceland = sorted(events.collect(), key=lambda r: r["unid"])
    assert tuple(iceland) == tuple(
        v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for v in (BASE[c] for c in EVENT_COLUMNS)
    )
    assert (other["flynn_region"], other["mag"]) == ("GREECE", 3.1)


def test_two_bodies(spark, body):
    body(collection(feature(unid="a")), "1.json")
    path = body(collection(feature(unid="b"), feature(unid="c")), "2.json")
    assert geojson.read_feature_collection(spark, path).count() == 3


@pytest.mark.parametrize("defect", [
    {"mag": ...}, {"mag": None}, {"mag": "big"}, {"time": "yesterday"}, {"unid": ...},
    {"arrivals": [{"id": "x"}]}, {"origins": {"origins": [{"Source_id": "x"}]}},
])
def test_one_bad_feature(spark, body, defect):
    path = body(collection(feature(unid="good"), feature(**{"unid": "bad"} | defect)))
    with pytest.raises(Exception, match="bad event"):
        geojson.read_feature_collection(spark, path).collect()
    parsed = geojson.read_feature_collection(spark, path, mode="quarantine")
    assert [r["unid"] for r in parsed.filter("error is null").collect()] == ["good"]
    bad = parsed.filter("error is not null").collect()
    assert len(bad) == 1 and "properties" in bad[0]["feature"]


@pytest.mark.parametrize("text", ["", "nonsense", "[]", '{"type":"FeatureCollection"}', '{"features":[17]}'])
def test_bodies_that_are_no_collection(spark, body, text):
    path = body(text)
    with pytest.raises(Exception):
        geojson.read_feature_collection(spark, path).collect()
    assert geojson.read_feature_collection(spark, path, "quarantine").filter("error is null").count() == 0


def test_empty_collection_is_fine(spark, body):
    assert geojson.read_feature_collection(spark, body(collection())).count() == 0


def test_unknown_mode(spark, body):
    with pytest.raises(ValueError):
        geojson.read_feature_collection(spark, body(collection()), "lenient")


def test_features_round_trip(spark, make, tmp_path):
    events = make({}, {"unid": "b", "mag": 3.25, "flynn_region": 'A "quoted", name'})
    path = str(tmp_path / "out")
    geojson.write_feature_collection(events, path)
    back = geojson.to_event_table(geojson.read_feature_lines(spark, path))
    assert sorted(tuples(back)) == sorted(tuples(events))
    first = json.loads(spark.read.text(path).orderBy("value").first()["value"])
    assert first["type"] == "Feature"
    assert first["geometry"]["coordinates"] == [BASE["lon"], BASE["lat"]]
    assert first["properties"]["auth"] == "OBS" and "author" not in first["properties"]


def test_records_fill_nulls(make):
    record = geojson.to_event_records(make({"depth": None, "flynn_region": None, "time": None})).select(
        "depth", "flynn_region", F.unix_micros("time").alias("us"), "geometry.type", "auth"
    )
    assert tuples(record) == [(0.0, "", 0, "Point", "OBS")]


def test_nested_parts(spark, body):
    origins = {"geometry": {"type": "Point", "coordinates": [1, 2]}, "origins": [
        {"Source_id": "o1", "Source_catalog": "c", "Lastupdate": "2023-03-14T07:01:05Z",
         "Time": "2023-03-14T06:15:42Z", "Lat": 1.0, "Lon": 2.0, "Depth": 3.0, "Nsta": 4,
         "mags": [{"Value": 2.0, "Type": "ml"}, {"Value": 2.2, "Type": "mw", "Nsta": 3}]},
        {"Source_id": "o2", "Source_catalog": "c", "Lastupdate": "2023-03-14T07:01:05Z",
         "Time": "2023-03-14T06:15:42Z", "Lat": 1.0, "Lon": 2.0, "Depth": 3.0},
    ]}
    arrivals = [{"id": "a1", "Sta": "XYZ", "Dist": 1.5, "stamag": [{}]}, {"id": "a2", "Sta": "ABC"}]
    path = body(collection(feature(unid="n", origins=origins, arrivals=arrivals), feature(unid="plain")))
    records = geojson.read_feature_collection(spark, path)
    flat = nested.flatten_origins(records).select("unid", "origin_source_id", "mag_value", "mag_nsta")
    assert sorted(tuples(flat), key=str) == sorted([
        ("n", "o1", 2.0, None), ("n", "o1", 2.2, 3), ("n", "o2", None, None), ("plain", None, None, None)
    ], key=str)
    flat = nested.flatten_arrivals(records).select("unid", "arrival_sta", "arrival_dist")
    assert sorted(tuples(flat), key=str) == sorted([
        ("n", "ABC", None), ("n", "XYZ", 1.5), ("plain", None, None)
    ], key=str)


@pytest.mark.parametrize("line", [
    "not json", '{"action":"create"}', '{"action":"delete","data":%s}' % json.dumps(feature()),
    '{"data":%s}' % json.dumps(feature()), '{"action":"create","data":{"type":"Feature"}}',
])
def test_bad_messages(spark, line):
    good = json.dumps({"action": "update", "data": feature()})
    parsed = messages.parse_messages(spark.createDataFrame([(line,), (good,)], "value STRING"))
    assert [r["action"] for r in messages.accepted(parsed).collect()] == ["update"]
    assert [r["value"] for r in messages.rejected(parsed).collect()] == [line]


def test_table_append_clear_and_pruning(spark, make, tmp_path):
    path = str(tmp_path / "events")
    events = make(time=[utc(2024, 1, 1, 23, 59), utc(2024, 1, 2), utc(2024, 1, 3, 12)])
    event_table.write_events(events, path)
    event_table.write_events(events, path)
    assert event_table.read_events(spark, path).count() == 6
    event_table.write_events(events, path, clear=True)
    assert sorted(tuples(event_table.read_events(spark, path))) == sorted(tuples(events))

    part = event_table.read_events(spark, path, utc(2024, 1, 2), utc(2024, 1, 2, 23))
    assert [r["unid"] for r in part.collect()] == ["test_1"]
    scanned = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in scanned

    event_table.clear_events(spark, path)
    assert event_table.read_events(spark, path).count() == 0
    event_table.write_events(events, path)
    assert event_table.read_events(spark, path).count() == 3


def test_work_folders_can_be_removed(spark):
    from temblor import session

    path = session.new_work_folder(spark, "scrap")
    spark.range(3).write.parquet(path)
    others = [p for p in session._WORK_FOLDERS if p != path]
    session._WORK_FOLDERS[:] = [path]
    assert session.remove_work_folders(spark) == 1
    session._WORK_FOLDERS[:] = others
    with pytest.raises(Exception):
        spark.read.parquet(path)
