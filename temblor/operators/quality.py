"""Range rules for events and the split into valid and quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from temblor.schema import EVENT_COLUMNS

# Accepted ranges, both ends included, and the id length in bytes.
RANGES = {
    "mag": (-2.0, 10.0),
    "depth": (0.0, 700.0),
    "lat": (-90.0, 90.0),
    "lon": (-180.0, 180.0),
}
MAX_ID_BYTES = 100


def check_range(name: str, value: float) -> None:
    """The range rule for a plain number; raises ValueError."""
    low, high = RANGES[name]
    if not low <= value <= high:
        raise ValueError(f"{name} {value} is not in {low}..{high}")


def check_event_id(value: str) -> None:
    if not 1 <= len(value.encode()) <= MAX_ID_BYTES:
        raise ValueError(f"event id must have 1 to {MAX_ID_BYTES} bytes")


def event_errors() -> Column:
    """Array with one entry per broken rule; empty for a valid event."""
    checks = [
        F.when(~F.col(name).between(low, high), F.lit(f"{name} out of range"))
        for name, (low, high) in RANGES.items()
    ]
    id_bytes = F.octet_length("unid")
    checks.append(F.when(id_bytes == 0, F.lit("unid empty")))
    checks.append(F.when(id_bytes > MAX_ID_BYTES, F.lit("unid too long")))
    checks += [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in EVENT_COLUMNS]
    return F.array_compact(F.array(*checks))


def check_events(events: DataFrame) -> DataFrame:
    """All events with their ``errors``."""
    return events.withColumn("errors", event_errors())


def quarantine_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, invalid events with their ``errors``).

    Each of the two reads ``events`` on its own; ``write_checked`` reads them once.
    """
    checked = check_events(events)
    bad = F.size("errors") > 0
    return checked.filter(~bad).drop("errors"), checked.filter(bad)


def write_checked(events: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The same two frames, from one pass over ``events`` that writes both to ``path``."""
    checked = check_events(events).withColumn("valid", F.size("errors") == 0)
    checked.write.partitionBy("valid").parquet(path)
    stored = events.sparkSession.read.schema(checked.schema).parquet(path)
    return stored.filter("valid").drop("errors", "valid"), stored.filter("not valid").drop("valid")
