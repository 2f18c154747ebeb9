"""Worked examples of the aggregates, with values found by hand."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import hours, tuples, utc
from temblor.operators import geo, magnitude as m, risk, stats, temporal
from temblor.sources.geojson import empty_events


def histogram(events):
    return tuples(m.magnitude_distribution(events))


def test_histogram_bars(make):
    # A bar is two tenths wide and named by its lower end; further decimals are cut off.
    events = make(mag=[5.55, 0.0, 3.39, 3.2, 5.4, 0.19, 3.61, 7.0, 5.41])
    assert histogram(events) == [("0", 2), ("3.2", 2), ("3.6", 1), ("5.4", 3), ("7", 1)]


def test_histogram_of_a_falling_series(make):
    events = make(mag=[6.75 - 0.25 * i for i in range(9)])
    assert histogram(events) == [
        (bar, 1) for bar in ("4.6", "5", "5.2", "5.4", "5.6", "6", "6.2", "6.4", "6.6")
    ]


def test_histogram_is_in_numeric_order(make):
    assert [label for label, _ in histogram(make(mag=[9.9, 10.0, 2.0]))] == ["2", "9.8", "10"]


def test_daily_counts(make, base_time):
    events = make(time=[base_time + timedelta(days=i // 2) for i in range(5)])
    assert tuples(temporal.daily_counts(events)) == [
        (date(2023, 3, 14), 2), (date(2023, 3, 15), 2), (date(2023, 3, 16), 1)
    ]


@pytest.fixture
def spread(make):
    start = utc(2024, 1, 15, 10, 30)
    shifts = [hours(0), hours(5), hours(12), hours(24), hours(32 * 24), hours(72)]
    return make(time=[start + s for s in shifts])


def test_calendar_units(spread):
    assert tuples(temporal.daily_counts(spread)) == [
        (date(2024, 1, 15), 3), (date(2024, 1, 16), 1), (date(2024, 1, 18), 1), (date(2024, 2, 16), 1)
    ]
    assert tuples(temporal.hourly_frequency(spread)) == [(10, 4), (15, 1), (22, 1)]
    assert tuples(temporal.monthly_frequency(spread)) == [(1, 5), (2, 1)]
    assert tuples(temporal.weekly_frequency(spread)) == [
        ("Mon", 3), ("Tue", 1), ("Wed", 0), ("Thu", 1), ("Fri", 1), ("Sat", 0), ("Sun", 0)
    ]
    assert tuples(temporal.with_month_names(temporal.monthly_frequency(spread))) == [
        ("Jan", 1, 5), ("Feb", 2, 1)
    ]


def test_calendar_units_do_not_follow_the_session_zone(spark, spread):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert tuples(temporal.hourly_frequency(spread)) == [(10, 4), (15, 1), (22, 1)]
        assert temporal.daily_counts(spread).first()["date"] == date(2024, 1, 15)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_times_before_1970(make):
    events = make(time=[utc(1969, 12, 31, 23, 59, 59), utc(1906, 4, 18, 13, 12, 21)])
    assert tuples(temporal.daily_counts(events)) == [(date(1906, 4, 18), 1), (date(1969, 12, 31), 1)]
    assert tuples(temporal.hourly_frequency(events)) == [(13, 1), (23, 1)]


def test_week_has_one_event_each_day(make):
    events = make(time=[utc(2024, 1, 15) + timedelta(days=i) for i in range(7)])
    assert {n for _, n in tuples(temporal.weekly_frequency(events))} == {1}


def test_no_events(spark):
    nothing = empty_events(spark)
    for operator in (
        m.magnitude_distribution, temporal.daily_counts, temporal.hourly_frequency,
        temporal.monthly_frequency, geo.region_hotspots, geo.coordinate_clusters,
        m.magnitude_frequency, geo.region_pie,
    ):
        assert tuples(operator(nothing)) == []
    assert [n for _, n in tuples(temporal.weekly_frequency(nothing))] == [0] * 7
    assert tuples(risk.risk_metrics(nothing)) == [(0.0, 0.0, 0.0, 0.0)]
    assert tuples(m.gr_fit(nothing)) == [(1.0, 0.0, 2.0)]
    assert tuples(m.gr_fit_published(nothing)) == [(1.0, 0.0, 2.0)]
    assert tuples(m.gr_section(nothing)) == [(1.0, 0.0, 2.0, 0)]
    assert tuples(risk.time_span_days(nothing)) == [(1.0,)]
    assert tuples(stats.magnitude_stats(nothing)) == [(None,) * 5]
    assert tuples(stats.data_stats(nothing)) == [(0, None, 0)]


def test_clusters(make):
    events = make(
        lat=[35.0, 35.1, 35.2, 40.0, 40.1, 50.0], lon=[-120.0, -120.1, -120.2, -125.0, -125.1, -130.0]
    )
    assert sorted(tuples(geo.coordinate_clusters(events))) == [
        (35.0, -120.0, 3), (40.0, -125.0, 2), (50.0, -130.0, 1)
    ]


def test_grid_rounds_halves_away_from_zero(make):
    events = make(lat=[35.25, -0.25, 0.24999999999999997], lon=[-120.25, 0.0, -180.0])
    cells = {(lat, lon) for lat, lon, _ in tuples(geo.coordinate_clusters(events))}
    assert cells == {(35.5, -120.5), (-0.5, 0.0), (0.0, -180.0)}


def test_hotspots_break_ties_by_name(make):
    events = make(flynn_region=["California"] * 3 + ["Oregon", "Alaska"])
    assert tuples(geo.region_hotspots(events)) == [("California", 3), ("Alaska", 1), ("Oregon", 1)]


def test_hotspots_need_a_position_but_sections_keep_null_regions(make):
    events = make(
        {"flynn_region": "A"}, {"flynn_region": "A", "lat": None}, {"flynn_region": None}
    )
    assert tuples(geo.region_hotspots(events)) == [("A", 1)]
    assert {(r, n) for r, n, _ in tuples(geo.hotspot_section(events))} == {("A", 2), (None, 1)}


def test_pie_keeps_a_listed_region_called_others_apart(make):
    regions = ["Others"] * 30 + [f"r{i:02d}" for i in range(12) for _ in range(20 - i)]
    pie = tuples(geo.region_pie(make(flynn_region=regions)))
    assert pie[0] == ("Others", 30)
    assert pie[-1] == ("Others", (20 - 9) + (20 - 10) + (20 - 11))
    assert len(pie) == 11


def test_pie_of_few_regions_has_no_rest(make):
    assert tuples(geo.region_pie(make(flynn_region=["a", "b", "b"]))) == [("b", 2), ("a", 1)]


MAGS = (
    [2.0 + i / 10 for i in range(10)] + [3.0 + i / 10 for i in range(8)]
    + [4.0 + i / 10 for i in range(5)] + [5.0, 5.1, 5.2] + [6.0]
)


def test_frequency_table_counts_down(make):
    table = tuples(m.magnitude_frequency(make(mag=MAGS)))
    assert [c for _, _, c in table] == list(range(27, 0, -1))
    assert tuples(m.gr_fit(make(mag=MAGS)))[0][:2] == (0.0, 0.0)


def test_fit_of_an_exact_law(make):
    # 8, 4, 2 events per bin: ln n falls by ln 2 each 0.1.
    events = make(mag=[2.05] * 8 + [2.15] * 4 + [2.25] * 2 + [1.0] * 50)
    b, a, mc = tuples(m.gr_fit(events))[0]
    assert b == pytest.approx(-math.log(2) / 0.1)
    assert a == pytest.approx(math.log(4) - math.log(2) / 0.1 * 2.1)
    published = tuples(m.gr_fit_published(events))[0]
    assert published[0] > 0


def test_too_few_bins_give_the_defaults(make):
    assert tuples(m.gr_fit(make(mag=[2.0, 3.0])))[0][:2] == (1.0, 0.0)
    # Three bins, but only two at or above the completeness magnitude.
    assert tuples(m.gr_fit(make(mag=[1.0, 2.0, 3.0])))[0][:2] == (1.0, 0.0)


def test_risk_example(make):
    events = make(
        mag=[2.0, 3.0, 4.0, 5.0, 5.5, 6.0, 6.5],
        time=[utc(2024, 1, 1) + timedelta(days=i) for i in range(7)],
    )
    assert tuples(risk.time_span_days(events)) == [(6.0,)]
    p5, p6, p7, energy = tuples(risk.risk_metrics(events))[0]
    assert p5 == pytest.approx(1 - math.exp(-20))
    assert p6 == pytest.approx(1 - math.exp(-2 / 6 * 365))
    assert p7 == 0.0
    assert energy == pytest.approx(sum(10 ** (11.8 + 1.5 * x) for x in (2, 3, 4, 5, 5.5, 6, 6.5)))
    level, sentence = tuples(risk.risk_reading(events))[0][1:]
    assert (level, sentence) == ("High", "Increased likelihood of significant earthquakes")


def test_thresholds_compare_bins(make):
    # 4.999 is in bin 49, 5.09 in bin 50, as is a threshold of 5.05.
    events = make(mag=[4.999, 5.0, 5.09])
    assert tuples(risk.events_at_least(events, 5.05)) == [(2,)]


def test_risk_skips_events_without_time_but_counts_their_magnitude(make, base_time):
    events = make({"mag": 5.0}, {"mag": 6.0, "time": None}, {"mag": None})
    section = risk.risk_section(events).first()
    assert section["prob_mag6_365days"] == 0.0
    assert section["total_events"] == 2


def test_statistics(make):
    events = make(mag=[1.0, 2.0, 3.0, 10.0], depth=[5.0, None, 7.0, 9.0])
    mean, median, std, low, high = tuples(stats.magnitude_stats(events))[0]
    assert (mean, median, low, high) == (4.0, 2.5, 1.0, 10.0)
    assert std == pytest.approx(math.sqrt((9 + 4 + 1 + 36) / 3))
    assert tuples(stats.depth_stats(events))[0][:2] == (7.0, 7.0)


def test_statistics_of_one_event(make):
    assert tuples(stats.magnitude_stats(make(mag=[3.5]))) == [(3.5, 3.5, None, 3.5, 3.5)]


def test_approximate_median(make):
    row = stats.magnitude_stats(make(mag=[1.0, 2.0, 3.0]), median="approx").first()
    assert row["median_magnitude"] == 2.0
    with pytest.raises(ValueError):
        stats.magnitude_stats(make(mag=[1.0]), median="none")


def test_totals_agree(make):
    events = make(
        mag=[2.0 + (i % 50) / 10 for i in range(100)],
        depth=[5.0 + i % 40 for i in range(100)],
        lat=[35 + (i % 10) / 10 for i in range(100)],
        lon=[-120 - (i % 10) / 10 for i in range(100)],
        time=[utc(2024, 1, 1) + hours(i) for i in range(100)],
        flynn_region=[("California", "Oregon", "Washington")[i % 3] for i in range(100)],
    )
    bars = histogram(events)
    assert len(bars) == 25 and {n for _, n in bars} == {4}
    assert tuples(geo.region_hotspots(events)) == [
        ("California", 34), ("Oregon", 33), ("Washington", 33)
    ]
    for operator in (
        temporal.daily_counts, temporal.hourly_frequency, temporal.monthly_frequency,
        temporal.weekly_frequency, geo.coordinate_clusters,
    ):
        assert operator(events).agg(F.sum("count")).first()[0] == 100
    cumulative = [c for _, _, c in tuples(m.magnitude_frequency(events))]
    assert cumulative[0] == 100 and cumulative == sorted(cumulative, reverse=True)
