from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import tuples, utc
from temblor.operators import filters, ordering, quality
from temblor.operators.query import QueryParams, constrain, query_events


def ids(frame):
    return [r["unid"] for r in frame.collect()]


def test_range_and_box_are_inclusive(make):
    events = make(time=[utc(2024, 1, d) for d in (1, 2, 3)], lat=[1.0, 2.0, 3.0], lon=[5.0, 6.0, 7.0])
    assert ids(filters.events_in_range(events, utc(2024, 1, 1), utc(2024, 1, 2))) == ["test_0", "test_1"]
    assert ids(filters.events_in_bbox(events, 2, 3, 6, 7)) == ["test_1", "test_2"]


def test_magnitude_filter_then_rebuild(make):
    from temblor.operators.magnitude import magnitude_distribution

    kept = filters.events_above_magnitude(make(mag=[2.0, 3.0, 4.0, 5.0, 6.0]), 4.0)
    assert kept.count() == 3
    assert magnitude_distribution(kept).count() == 3


def test_pairs_need_both(make):
    values = [(2.0, 5.0), (3.5, 15.0), (4.0, 25.0), (5.5, 35.0), (6.0, 45.0), (None, 1.0), (1.0, None)]
    events = make(*[{"mag": m, "depth": d} for m, d in values])
    assert sorted(tuples(filters.mag_depth_pairs(events))) == values[:5]


@pytest.mark.parametrize("bad", [
    {"start": utc(2024, 2, 1), "end": utc(2024, 1, 1)},
    {"minlat": -91}, {"maxlat": 95}, {"minlon": -181}, {"maxlon": 200}, {"lat": 91}, {"lon": 181},
    {"minlat": 5, "maxlat": 4}, {"minlon": 5, "maxlon": 4},
    {"minradius": -1, "maxradius": 5}, {"minradius": 6, "maxradius": 5},
    {"mindepth": -1}, {"maxdepth": 701}, {"mindepth": 5, "maxdepth": 4},
    {"minmag": -3}, {"maxmag": 11}, {"minmag": 5, "maxmag": 4},
    {"limit": 0}, {"limit": 20001}, {"offset": -1}, {"eventid": ""}, {"eventid": "x" * 101},
    {"orderby": "depth"},
])
def test_bad_parameters_are_refused(make, bad):
    with pytest.raises(ValueError):
        query_events(make({}), QueryParams.from_dict(bad))


def test_unknown_parameters_are_refused():
    with pytest.raises(ValueError, match="min_magnitude"):
        QueryParams.from_dict({"min_magnitude": 3})


def test_default_page(make, base_time):
    events = make(time=[base_time + timedelta(seconds=i) for i in range(60)])
    assert ids(query_events(events, QueryParams())) == [f"test_{i}" for i in range(59, 9, -1)]


@pytest.mark.parametrize("order,first", [
    ("time", "test_2"), ("time-asc", "test_0"), ("magnitude", "test_1"), ("magnitude-asc", "test_0"),
])
def test_orders(make, base_time, order, first):
    events = make(time=[base_time + timedelta(seconds=i) for i in range(3)], mag=[1.0, 3.0, 2.0])
    assert ids(query_events(events, QueryParams(orderby=order)))[0] == first


def test_constraints(make):
    events = make(
        {"magtype": "Mw", "author": "A", "source_catalog": "X", "lastupdate": utc(2024, 1, 2)},
        {"magtype": "mw", "author": "B", "source_catalog": "X", "lastupdate": utc(2024, 1, 3)},
        {"magtype": "ml", "author": "A", "source_catalog": "Y", "lastupdate": utc(2024, 1, 4)},
    )

    def found(**params):
        return ids(constrain(events, QueryParams(**params)))

    assert found(magtype="MW") == ["test_0", "test_1"]
    assert found(contributor="A") == ["test_0", "test_2"]
    assert found(catalog="Y") == ["test_2"]
    assert found(eventid="test_1") == ["test_1"]
    assert found(updatedafter=utc(2024, 1, 3)) == ["test_2"]
    assert found(magtype="mw", contributor="A") == ["test_0"]


def test_circle_units(make):
    # One degree of latitude is about 111.2 km.
    events = make(lat=[0.0, 1.0, 2.0], lon=[0.0, 0.0, 0.0])

    def found(unit, low, high):
        params = QueryParams(lat=0.0, lon=0.0, minradius=low, maxradius=high)
        return ids(constrain(events, params, unit))

    assert found("m", 100_000, 120_000) == ["test_1"]
    assert found("km", 100, 230) == ["test_1", "test_2"]
    assert found("deg", 0, 1.5) == ["test_0", "test_1"]


def test_circle_over_the_date_line(make):
    events = make(lat=[0.0, 0.0, 0.0], lon=[179.9, -179.9, 170.0])
    around = QueryParams(lat=0.0, lon=180.0, maxradius=50_000)
    assert ids(constrain(events, around)) == ["test_0", "test_1"]


def test_quarantine(make):
    events = make({"mag": 15.0}, {"lat": 95.0}, {"lon": 200.0}, {"mag": 5.0}, {"lat": 45.0}, {"lon": 120.0},
                  {"unid": ""}, {"unid": "é" * 51}, {"depth": None}, {"mag": float("nan")})
    valid, invalid = quality.quarantine_events(events)
    assert ids(valid) == ["test_3", "test_4", "test_5"]
    reasons = [r["errors"] for r in invalid.collect()]
    assert reasons == [
        ["mag out of range"], ["lat out of range"], ["lon out of range"],
        ["unid empty"], ["unid too long"], ["depth missing"], ["mag out of range"],
    ]


@pytest.fixture
def tied(spark, make):
    """6,000 events of which a third share one microsecond."""
    base = make({}).drop("unid", "time")
    numbers = spark.range(6000, numPartitions=4)
    micros = F.when(F.col("id") % 3 == 0, 1_700_000_000_000_000).otherwise(
        1_699_999_000_000_000 + F.col("id") * 400_001
    )
    events = numbers.join(base).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("unid"),
        F.timestamp_micros(micros).alias("time"), *base.columns,
    )
    return events


@pytest.mark.parametrize("n", [5, 1500, 3000, 4500, 6000, 7000])
def test_newest_events_are_the_newest(tied, n):
    expected = sorted((r["time"] for r in tied.collect()), reverse=True)[:n]
    result = ordering.newest_events(tied, n)
    assert sorted((r["time"] for r in result.collect()), reverse=True) == expected
    assert result.select("unid").distinct().count() == len(expected)


@pytest.mark.parametrize("order", ["time", "time-asc"])
@pytest.mark.parametrize(
    "limit,offset", [(1200, 0), (1500, 1000), (2000, 2500), (50, 5980), (3000, 5000), (5, 9000)]
)
def test_deep_pages(tied, order, limit, offset):
    rows = [(r["time"], r["unid"]) for r in tied.collect()]
    rows.sort(key=lambda r: r[1])
    rows.sort(key=lambda r: r[0], reverse=order == "time")
    result = ordering.page(tied, order, limit, offset)
    assert [(r["time"], r["unid"]) for r in result.collect()] == rows[offset:offset + limit]


@pytest.mark.parametrize("order", ["time", "time-asc", "magnitude", "magnitude-asc"])
@pytest.mark.parametrize("limit,offset", [(3, 0), (4, 2), (7, 5), (10, 20), (25, 18), (60, 0), (9, 39), (5, 70), (2, 36)])
def test_pages_equal_the_plain_sort(make, monkeypatch, order, limit, offset):
    monkeypatch.setattr(ordering, "SHORT_LIST", 1)
    mags = [float("nan"), None, 0.0, -0.0, 1.5, 1.5, 2.0, float("nan"), 3.0]
    times = [utc(2024, 1, 1), utc(2024, 1, 1), utc(2024, 1, 2), None, utc(2023, 5, 5), utc(2024, 1, 1)]
    events = make(*[{"unid": f"id{i * 7 % 40:03d}", "mag": mags[i % 9], "time": times[i % 6]} for i in range(40)])
    expected = [r["unid"] for r in events.orderBy(*ordering.order_columns(order)).offset(offset).limit(limit).collect()]
    assert [r["unid"] for r in ordering.page(events, order, limit, offset).collect()] == expected


def test_part_of_a_circle_is_refused():
    for wrong in ({"maxradius": 1000}, {"lat": 10.0, "maxradius": 1000}, {"lat": 1.0, "lon": 1.0}, {"lat": 1.0, "lon": 1.0, "maxradius": -1}):
        with pytest.raises(ValueError):
            QueryParams(**wrong).validate()


@pytest.fixture(scope="module")
def tied_magnitudes(spark, make):
    """6,000 events, most of which have one of three magnitudes; some share their time too."""
    base = make({}).drop("unid", "time", "mag")
    n = F.col("id")
    events = spark.range(6000, numPartitions=4).join(base).select(
        F.lpad(n.cast("string"), 6, "0").alias("unid"),
        F.timestamp_micros(1_700_000_000_000_000 + (n * 7919 % 6000) * 250_000).alias("time"),
        F.when(n % 5 < 4, F.element_at(F.array(*map(F.lit, (2.0, 3.5, 3.5))), (n % 3 + 1).cast("int")))
        .otherwise(n / 1000).alias("mag"),
        *base.columns,
    )
    path = f"{spark.conf.get('spark.checkpoint.dir')}/tied_magnitudes"
    events.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("order", ["magnitude", "magnitude-asc"])
@pytest.mark.parametrize(
    "limit,offset", [(1200, 0), (1500, 1000), (2500, 3000), (1, 1500), (900, 5100), (900, 5200)]
)
def test_deep_pages_by_magnitude(tied_magnitudes, order, limit, offset):
    rows = [(r["mag"], r["time"], r["unid"]) for r in tied_magnitudes.collect()]
    rows.sort(key=lambda r: r[2])
    rows.sort(key=lambda r: r[1], reverse=True)
    rows.sort(key=lambda r: r[0], reverse=order == "magnitude")
    result = ordering.page(tied_magnitudes, order, limit, offset)
    assert [(r["mag"], r["time"], r["unid"]) for r in result.collect()] == rows[offset:offset + limit]


def test_map_events(make):
    def double(batches):
        for batch in batches:
            yield batch[["mag"]] * 2

    assert tuples(filters.map_events(make(mag=[1.0, 2.0]), double, "mag DOUBLE")) == [(2.0,), (4.0,)]


def test_event_frame_as_view(spark, make):
    filters.event_frame(make(mag=[1.0, 5.0]), "some_quakes")
    assert spark.sql("SELECT count(*) FROM some_quakes WHERE mag > 2").first()[0] == 1
