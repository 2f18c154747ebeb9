"""Orders, top rows and pages.

``orderBy(...).limit(n)`` keeps ``n`` rows in every task and merges them all in one. That
is right for short lists. For long ones the functions here count first: a few small
aggregations find the time at a rank, and the rows are then taken by a plain time filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from temblor.functions.calendar import DAY_US, time_within
from temblor.operators.quantiles import values_at_ranks

# Up to this many rows a per-task top list is cheaper than counting. Rows and order are the same.
SHORT_LIST = 1000

# Day, second, microsecond: each step has a bounded number of distinct steps in the last.
_WIDTHS = (DAY_US, 1_000_000, 1)

# Ids that share a beginning are counted by so many further characters at a time.
_ID_STEP = 2


def chronological_events(events: DataFrame) -> DataFrame:
    """All events, oldest first; equal times by id."""
    return events.orderBy("time", "unid")


def order_columns(name: str) -> list[Column]:
    """Sort columns of an order name; a bare name means descending."""
    orders = {
        "time": [F.desc("time"), F.asc("unid")],
        "time-asc": [F.asc_nulls_last("time"), F.asc("unid")],
        "magnitude": [F.desc("mag"), F.desc("time"), F.asc("unid")],
        "magnitude-asc": [F.asc_nulls_last("mag"), F.desc("time"), F.asc("unid")],
    }
    if name not in orders:
        raise ValueError(f"unknown order {name!r}; use one of {sorted(orders)}")
    return orders[name]


@dataclass(frozen=True)
class TimeRank:
    """The time of a row at some rank and the number of rows strictly ahead of it."""

    micros: int
    ahead: int
    ties: int

    def literal(self) -> Column:
        return F.timestamp_micros(F.lit(self.micros))


def times_at_ranks(
    events: DataFrame, ranks: list[int], newest_first: bool = True
) -> list[TimeRank | None]:
    """Where ranks (from 1) fall in time order; None for a rank beyond the last row.

    Counts per day, then per second of the days found, then per microsecond of the seconds
    found. After the first step the filter on ``time`` leaves a small part of the table to
    read. Each step brings one row per rank to the driver.
    """
    micros = F.unix_micros("time")
    inside = events.filter(F.col("time").isNotNull())
    parent, ahead = F.lit(0), F.lit(0)
    steps: dict[int, tuple[int, int, int]] = {}
    for width in _WIDTHS:
        start = micros - F.pmod(micros, F.lit(width))
        counts = inside.groupBy(parent.alias("parent"), start.alias("start")).agg(
            F.count("*").alias("n")
        )
        order = F.desc("start") if newest_first else F.asc("start")
        running = Window.partitionBy("parent").orderBy(order)
        placed = counts.withColumn("upto", F.sum("n").over(running) + ahead)
        holds = [
            (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank) for rank in ranks
        ]
        found = placed.filter(reduce(Column.__or__, holds)).collect()
        steps = {
            rank: (row["start"], row["upto"] - row["n"], row["n"])
            for rank in ranks
            for row in found
            if row["upto"] - row["n"] < rank <= row["upto"]
        }
        if not steps:
            break
        spans = {first: before for first, before, _ in steps.values()}
        within = [
            time_within(
                events.columns,
                at_least=F.timestamp_micros(F.lit(first)),
                before=F.timestamp_micros(F.lit(first + width)),
            )
            for first in spans
        ]
        inside = events.filter(reduce(Column.__or__, within))
        parent = start
        ahead = reduce(
            lambda column, span: F.when(F.col("parent") == span[0], span[1]).otherwise(column),
            spans.items(),
            F.lit(0),
        )
    return [TimeRank(*steps[rank]) if rank in steps else None for rank in ranks]


def newest_events(events: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events, newest first; equal times by id, events without a time last."""
    return page(events, "time", n)


def _id_at(tied: DataFrame, rank: int) -> tuple[str, int]:
    """The id at a rank (from 1) in id order, and how many of its rows the rank takes in.

    Ids are counted by their beginnings, a few characters further each time, until a short list is
    left. So no task orders all ties. No id counts as the empty one.
    """
    prefix, rest, size = "", rank, SHORT_LIST + 1
    name = F.coalesce("unid", F.lit(""))
    while size > SHORT_LIST:
        upto = len(prefix) + _ID_STEP
        counts = tied.filter(name.startswith(prefix)).groupBy(F.substring(name, 1, upto).alias("b")).agg(F.count("*").alias("n"))
        running = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        cut = counts.withColumn("upto", F.sum("n").over(running)).filter(F.col("upto") >= rest).orderBy("upto").first()
        rest -= cut["upto"] - cut["n"]
        prefix, size = cut["b"], cut["n"]
        if len(prefix) < upto:
            return prefix, rest
    names = sorted(r["name"] for r in tied.filter(name.startswith(prefix)).select(name.alias("name")).collect())
    return names[rest - 1], rest - names.index(names[rest - 1])


def _by_id(tied: DataFrame, skipped: int, wanted: int, available: int) -> DataFrame:
    """Of events that share everything else the ``wanted`` after the ``skipped`` smallest ids."""
    if wanted <= 0:
        return tied.limit(0)
    if not skipped and wanted >= available:
        return tied
    name = F.coalesce("unid", F.lit(""))
    after = _id_at(tied, skipped) if skipped else None
    upto = _id_at(tied, skipped + wanted) if skipped + wanted < available else None
    if after and upto and after[0] == upto[0]:
        return tied.filter(name == upto[0]).limit(wanted)
    inside = F.lit(True)
    if after:
        inside = inside & (name > after[0])
    if upto:
        inside = inside & (name < upto[0])
    found = tied.filter(inside)
    # Rows of one id are equal in the order; any of them will do.
    if after:
        at = tied.filter(name == after[0])
        found = found.unionByName(at.limit(at.count() - after[1]))
    if upto:
        found = found.unionByName(tied.filter(name == upto[0]).limit(upto[1]))
    return found


def page(events: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` of an order, in that order."""
    columns = order_columns(order)
    if offset + limit <= SHORT_LIST:
        return events.orderBy(*columns).offset(offset).limit(limit)
    by_key = _page_by_time if order.startswith("time") else _page_by_magnitude
    return by_key(events, order, limit, offset).orderBy(*columns)


def _page_by_time(events: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    """The wanted rows, in any order. Rows without a time come after all others."""
    newest_first = order == "time"
    first, last = times_at_ranks(events, [offset + 1, offset + limit], newest_first)
    untimed = events.filter(F.col("time").isNull())
    if first is None:
        timed, missing = events.agg(F.count("time"), F.count_if(F.col("time").isNull())).first()
        return _by_id(untimed, offset - timed, min(limit, timed + missing - offset), missing)

    def at(rank: TimeRank) -> DataFrame:
        return events.filter(time_within(events.columns, at_least=rank.literal(), at_most=rank.literal()))

    skipped = offset - first.ahead
    if last is not None and last.micros == first.micros:
        return _by_id(at(first), skipped, limit, first.ties)
    head = _by_id(at(first), skipped, first.ties - skipped, first.ties)
    if last is None:
        # The page reaches past the last time: the far end is open, then come rows without a time.
        side = {"before": first.literal()} if newest_first else {"after": first.literal()}
        rest = events.filter(time_within(events.columns, **side))
        timed, missing = events.agg(F.count("time"), F.count_if(F.col("time").isNull())).first()
        wanted = min(max(offset + limit - timed, 0), missing)
        found = head.unionByName(rest)
        return found.unionByName(_by_id(untimed, 0, wanted, missing)) if wanted else found
    side = {"before": first.literal(), "after": last.literal()} if newest_first else {
        "after": first.literal(), "before": last.literal()}
    between = events.filter(time_within(events.columns, **side))
    tail = _by_id(at(last), 0, offset + limit - last.ahead, last.ties)
    return head.unionByName(between).unionByName(tail)


def _page_by_magnitude(events: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    """Magnitudes repeat a lot, so the ties at both ends are cut by time, newest first.

    NaN is the largest magnitude and equal to itself, as in a sort; rows without one come last.
    """
    mag = F.col("mag")
    total = events.agg(F.count("mag")).first()[0]
    without = events.filter(mag.isNull())
    if offset >= total:
        return page(without, "time", limit, offset - total)
    descending = order == "magnitude"
    end = min(offset + limit, total)
    # Ranks from 0 in ascending order, which is what value counts are in.
    ranks = [offset, end - 1]
    if descending:
        ranks = [total - 1 - rank for rank in ranks]
    first, last = map(F.lit, values_at_ranks(events, {"mag": ranks})["mag"])
    beyond = (mag > first, mag > last) if descending else (mag < first, mag < last)
    same, before_first, before_last, ties = events.agg(
        F.coalesce(F.any_value(first == last), F.lit(False)), F.count_if(beyond[0]), F.count_if(beyond[1]), F.count_if(mag == first)).first()
    at_first = events.filter(mag == first)
    skipped = offset - before_first
    if same:
        pages = page(at_first, "time", end - offset, skipped)
    else:
        between = events.filter(beyond[1] & ~beyond[0] & (mag != first))
        # The first tie group from where the page starts to its end, the last one up to the limit.
        head = page(at_first, "time", ties - skipped, skipped)
        tail = page(events.filter(mag == last), "time", end - before_last)
        pages = head.unionByName(between).unionByName(tail)
    return pages.unionByName(page(without, "time", offset + limit - total)) if offset + limit > total else pages
