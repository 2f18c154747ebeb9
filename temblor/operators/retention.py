"""Retention by age and by number of events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from temblor.functions.calendar import time_within, utc_literal
from temblor.operators.ordering import newest_events


@dataclass(frozen=True)
class RetentionConfig:
    """The defaults. 0 turns a rule off."""

    max_events: int = 100_000
    auto_cleanup: bool = True
    retention_days: int = 365

    def cutoff(self, as_of: datetime) -> datetime:
        return as_of - timedelta(days=self.retention_days)


def retention_old_count(events: DataFrame, cutoff: datetime) -> DataFrame:
    old = events.filter(time_within(events.columns, before=utc_literal(cutoff)))
    return old.agg(F.count("*").alias("count"))


def retention_keep(events: DataFrame, cutoff: datetime) -> DataFrame:
    return events.filter(time_within(events.columns, at_least=utc_literal(cutoff)))


def apply_retention(
    events: DataFrame, as_of: datetime, config: RetentionConfig
) -> DataFrame:
    """What is left at ``as_of``: recent events, and of those the newest ``max_events``.

    The time is an argument, so a run can be repeated. Write the result to a new path and
    switch readers over; do not overwrite the table that is being read.
    """
    if not config.auto_cleanup:
        return events
    kept = events
    if config.retention_days > 0:
        kept = retention_keep(kept, config.cutoff(as_of))
    if config.max_events > 0:
        kept = newest_events(kept, config.max_events)
    return kept
