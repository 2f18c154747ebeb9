"""The base event and small shorthands of the tests."""

from datetime import datetime, timedelta, timezone

BASE = {
    "unid": "iceland-77",
    "lat": 64.0625,
    "lon": -21.375,
    "time": datetime(2023, 3, 14, 6, 15, 42, 250000, tzinfo=timezone.utc),
    "mag": 2.0,
    "magtype": "mlw",
    "depth": 7.5,
    "evtype": "se",
    "flynn_region": "REYKJANES",
    "source_id": "r-4410",
    "source_catalog": "NORTH",
    "lastupdate": datetime(2023, 3, 14, 7, 1, 5, 500250, tzinfo=timezone.utc),
    "author": "OBS",
}


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def hours(n):
    return timedelta(hours=n)


def tuples(frame):
    return [tuple(row) for row in frame.collect()]
