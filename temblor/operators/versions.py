"""Repeats and updates of an event id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from temblor.schema import EVENT_COLUMNS


def _one_per_id(events: DataFrame, pick, order: tuple[str, ...]) -> DataFrame:
    # The whole row closes the order, so equal versions give the same result in every run.
    row = F.struct(*order, *[c for c in events.columns if c not in order])
    best = events.filter(F.col("unid").isNotNull()).groupBy("unid").agg(pick(row).alias("_row"))
    named = best.select(*[F.col(f"_row.{c}").alias(c) for c in events.columns])
    # Nothing says that two events without an id are the same one.
    return named.unionByName(events.filter(F.col("unid").isNull()))


def first_wins(events: DataFrame, order: tuple[str, ...] = ("lastupdate",)) -> DataFrame:
    """The first version of each id; events without id all stay.

    ``order`` names the columns that give the order of arrival. Copies are combined before the
    shuffle, so an id that is repeated very often arrives as one row per input task.
    """
    return _one_per_id(events, F.min, order)


def latest_wins(events: DataFrame, order: tuple[str, ...] = ("lastupdate",)) -> DataFrame:
    """The newest version of each id; events without id all stay."""
    return _one_per_id(events, F.max, order)


def current_events(versions: DataFrame, on_update: str = "latest", arrival: tuple[str, ...] = ()) -> DataFrame:
    """One row per id of a table that holds every version received.

    ``first`` keeps what arrived first, ``latest`` the newest ``lastupdate`` and, of equal ones, what
    arrived last. ``arrival`` names the columns of the order of arrival; without them ``lastupdate``
    stands for it.
    """
    if on_update == "first":
        return first_wins(versions, arrival or ("lastupdate",)).select(*EVENT_COLUMNS)
    if on_update == "latest":
        return latest_wins(versions, ("lastupdate", *arrival)).select(*EVENT_COLUMNS)
    raise ValueError("on_update must be 'first' or 'latest'")


# A batch of up to so many rows is sent to the readers of the known table: a few MB of ids.
SMALL_BATCH = 100_000


def _ids_of_batch(events: DataFrame) -> DataFrame:
    """The ids of a batch. They are counted, as Spark does not know the size of a micro-batch."""
    ids = events.select("unid")
    return F.broadcast(ids) if ids.count() <= SMALL_BATCH else ids


def new_events_only(incoming: DataFrame, known: DataFrame, arrival: tuple[str, ...] = ("lastupdate",)) -> DataFrame:
    """Incoming events whose id is not known yet, one row per id.

    The known table is only looked through for the ids of the batch: where these are few, they
    are sent to its readers and the table is not shuffled.
    """
    hits = known.select("unid").join(_ids_of_batch(incoming), "unid", "left_semi").distinct()
    return first_wins(incoming, arrival).join(hits, "unid", "left_anti")


def add_events(known: DataFrame, incoming: DataFrame, dedupe: bool = True) -> DataFrame:
    """The table after a batch: only new ids, or every row when ``dedupe`` is off."""
    return known.unionByName(new_events_only(incoming, known) if dedupe else incoming)


def upsert_events(
    known: DataFrame, incoming: DataFrame, on_update: str = "latest", arrival: tuple[str, ...] = ()
) -> DataFrame:
    """The table after a batch in which known ids may come with new values.

    ``known`` has one row per id and arrived before ``incoming``: under ``first`` it always stays,
    under ``latest`` it gives way to a version with an equal or newer ``lastupdate``. Only the ids
    of the batch are resolved; all other known rows pass through unshuffled where the batch is small.
    """
    known = known.select(*EVENT_COLUMNS)
    fresh = current_events(incoming, on_update, arrival)
    ids = _ids_of_batch(incoming)
    if on_update == "first":
        hits = known.select("unid").join(ids, "unid", "left_semi").distinct()
        return known.unionByName(fresh.join(hits, "unid", "left_anti"))
    untouched = known.join(ids, "unid", "left_anti")
    touched = known.join(ids, "unid", "left_semi")
    both = touched.withColumn("_arrival", F.lit(0)).unionByName(fresh.withColumn("_arrival", F.lit(1)))
    return untouched.unionByName(latest_wins(both, ("lastupdate", "_arrival")).drop("_arrival"))
