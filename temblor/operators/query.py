"""The catalogue query: optional constraints, order, limit and offset as one call."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from temblor.functions.calendar import time_within, utc_literal
from temblor.functions.geo import EARTH_RADIUS_KM, circle_box, haversine_km
from temblor.operators.ordering import order_columns, page
from temblor.operators.quality import check_event_id, check_range

# Page size limits, and kilometres per radius unit.
DEFAULT_LIMIT = 50
MAX_LIMIT = 20000
RADIUS_UNITS = {"m": 0.001, "km": 1.0, "deg": EARTH_RADIUS_KM * 3.141592653589793 / 180}


@dataclass(frozen=True)
class QueryParams:
    """The parameter names of the public catalogue query.

    ``format`` and ``nodata`` describe the remote answer and have no effect here.
    """

    start: datetime | None = None
    end: datetime | None = None
    minlat: float | None = None
    maxlat: float | None = None
    minlon: float | None = None
    maxlon: float | None = None
    lat: float | None = None
    lon: float | None = None
    minradius: float | None = None
    maxradius: float | None = None
    format: str = "json"
    nodata: str = "204"
    mindepth: float | None = None
    maxdepth: float | None = None
    minmag: float | None = None
    maxmag: float | None = None
    magtype: str | None = None
    includeallorigns: bool | None = None
    includearrivals: bool | None = None
    eventid: str | None = None
    limit: int = DEFAULT_LIMIT
    offset: int | None = None
    orderby: str | None = None
    contributor: str | None = None
    catalog: str | None = None
    updatedafter: datetime | None = None

    @classmethod
    def from_dict(cls, values: dict) -> QueryParams:
        """Parameters by name; an unknown name is an error, not ignored."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**values)

    def validate(self) -> None:
        """Raise ValueError for the first rule that is broken."""
        for name, values in {
            "lat": (self.minlat, self.maxlat, self.lat),
            "lon": (self.minlon, self.maxlon, self.lon),
            "depth": (self.mindepth, self.maxdepth),
            "mag": (self.minmag, self.maxmag),
        }.items():
            for value in values:
                if value is not None:
                    check_range(name, value)
        for low, high in (
            ("start", "end"),
            ("minlat", "maxlat"),
            ("minlon", "maxlon"),
            ("mindepth", "maxdepth"),
            ("minmag", "maxmag"),
            ("minradius", "maxradius"),
        ):
            a, b = getattr(self, low), getattr(self, high)
            if a is not None and b is not None and a > b:
                raise ValueError(f"{low} must not exceed {high}")
        radii = [r for r in (self.minradius, self.maxradius) if r is not None]
        if any(r < 0 for r in radii):
            raise ValueError("radii must not be negative")
        # Part of a circle would select as if there were none.
        if bool(radii) != (self.lat is not None and self.lon is not None) or (self.lat is None) != (self.lon is None):
            raise ValueError("a circle needs lat, lon and a radius")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be in 1..{MAX_LIMIT}")
        if self.offset is not None and self.offset < 0:
            raise ValueError("offset must not be negative")
        if self.eventid is not None:
            check_event_id(self.eventid)
        if self.orderby is not None:
            order_columns(self.orderby)


def _between(column: str, low, high) -> list[Column]:
    found = []
    if low is not None:
        found.append(F.col(column) >= low)
    if high is not None:
        found.append(F.col(column) <= high)
    return found


def time_constraint(params: QueryParams, columns: list[str]) -> list[Column]:
    limits = {"at_least": params.start, "at_most": params.end}
    return [
        time_within(columns, **{side: utc_literal(moment)})
        for side, moment in limits.items()
        if moment is not None
    ]


def box_constraint(params: QueryParams) -> list[Column]:
    return _between("lat", params.minlat, params.maxlat) + _between(
        "lon", params.minlon, params.maxlon
    )


def circle_constraint(params: QueryParams, radius_unit: str = "m") -> list[Column]:
    """Distance from the centre; needs both ``lat`` and ``lon`` and at least one radius."""
    if params.lat is None or params.lon is None:
        return []
    unit = RADIUS_UNITS[radius_unit]
    distance = haversine_km(F.col("lat"), F.col("lon"), params.lat, params.lon)
    found = []
    if params.maxradius is not None:
        box = circle_box(params.lat, params.lon, params.maxradius * unit)
        for column, (low, high) in box.items():
            found += _between(column, low, high)
        found.append(distance <= params.maxradius * unit)
    if params.minradius is not None:
        found.append(distance >= params.minradius * unit)
    return found


def depth_constraint(params: QueryParams) -> list[Column]:
    return _between("depth", params.mindepth, params.maxdepth)


def magnitude_constraint(params: QueryParams) -> list[Column]:
    return _between("mag", params.minmag, params.maxmag)


SHORT_NAME = 6  # letters of a name whose spellings are listed: 64 at most


def magtype_constraint(params: QueryParams) -> list[Column]:
    """Case does not matter: data and callers differ in it."""
    if params.magtype is None:
        return []
    wanted = params.magtype.lower()
    if wanted.isascii() and len(wanted) <= SHORT_NAME:
        # A list of spellings reaches the scan; a function of the column would not.
        spellings = {"".join(s) for s in product(*[{c, c.upper()} for c in wanted])}
        return [F.col("magtype").isin(sorted(spellings))]
    return [F.lower("magtype") == wanted]


def name_constraints(params: QueryParams) -> list[Column]:
    """Event id, contributor and catalogue."""
    wanted = {
        "unid": params.eventid,
        "author": params.contributor,
        "source_catalog": params.catalog,
    }
    return [F.col(c) == value for c, value in wanted.items() if value is not None]


def updated_constraint(params: QueryParams) -> list[Column]:
    if params.updatedafter is None:
        return []
    return [F.col("lastupdate") > utc_literal(params.updatedafter)]


def constrain(events: DataFrame, params: QueryParams, radius_unit: str = "m") -> DataFrame:
    """All rows that meet the constraints, without order and limit."""
    for condition in (
        time_constraint(params, events.columns)
        + box_constraint(params)
        + circle_constraint(params, radius_unit)
        + depth_constraint(params)
        + magnitude_constraint(params)
        + magtype_constraint(params)
        + name_constraints(params)
        + updated_constraint(params)
    ):
        events = events.filter(condition)
    return events


def query_events(events: DataFrame, params: QueryParams, radius_unit: str = "m") -> DataFrame:
    """The page of events that ``params`` ask for, newest first unless told otherwise."""
    params.validate()
    found = constrain(events, params, radius_unit)
    # Nested parts are handed out on request only.
    if not params.includeallorigns:
        found = found.drop("origins")
    if not params.includearrivals:
        found = found.drop("arrivals")
    return page(found, params.orderby or "time", params.limit, params.offset or 0)
