"""Loading, retention and clearing of a stored catalogue with its summary, each as one job."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from temblor.operators.retention import RetentionConfig
from temblor.plans import store as stores
from temblor.plans.store import Store
from temblor.session import remove_path


def load_events(
    spark: SparkSession, events: DataFrame, store: Store, load: str, clear: bool = False, dedupe: bool = True,
    check: bool = False, as_of: datetime | None = None, retention: RetentionConfig | None = None,
) -> None:
    """Take a batch of parsed events into the store; its summary is up to date afterwards.

    ``clear`` empties the store first. With ``dedupe`` an id comes in once, and not at all if it is
    known. With ``check`` events that break a rule are set aside. The load is known by its name: run
    again, after a crash or not, it replaces what it brought. With ``retention`` the store is cut to
    what is left at ``as_of`` afterwards.
    """
    if retention is not None and as_of is None:
        raise ValueError("retention needs as_of")
    if clear:
        stores.clear(spark, store)
    stores.take_in(spark, store, events, load, "first" if dedupe else "all", check=check)
    if retention is not None:
        stores.retain(spark, store, as_of, retention)


def run_retention(spark: SparkSession, store: Store, as_of: datetime, config: RetentionConfig) -> None:
    """Cut the store to what is left at ``as_of``: whole dates by their folders, boundaries by rewriting."""
    stores.retain(spark, store, as_of, config)


def clear_all(spark: SparkSession, store: Store, log: str | None = None) -> None:
    """Leave an empty store with the summary of no events. With ``log``, the root of an ingest log, its
    versions, rejects and emitted messages go as well; its stream's own checkpoint stays, so nothing
    that was cleared is read again."""
    stores.clear(spark, store)
    for kind in ("versions", "rejects", "emitted") if log is not None else ():
        remove_path(spark, f"{log}/{kind}")
