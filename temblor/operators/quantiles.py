"""Exact values at ranks of numeric columns, found by mergeable sketches and counts.

A KLL sketch of a column brackets the wanted rank; a scan then counts what lies below, at and between
the bracket's ends, and sketches what is between, so the next bracket is some twenty-five times
narrower. Both ends leave the bracket with all their repeats, however many. Once few distinct values are
left, they alone are ordered. The counts decide, the sketch only proposes, so the result is exact.
Every scan sends one row for each task; several ranks and columns share it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

FEW = 50_000  # about so many distinct values are ordered by one task at most
_SKETCH_K = 400
_GRID = 200
_AROUND = 0.02  # share of the values on either side of the wanted rank that a bracket takes in


@dataclass
class _Target:
    """A rank (from 0) of a column, and the open interval that holds its value."""

    column: str
    rank: int
    low: float | None = None
    high: float | None = None
    before: int = 0  # values up to ``low``
    inside: int = 0
    distinct: int = 0
    total: int = 0  # values of the whole column, NaN included
    quantiles: list[float] | None = None
    value: float | None = None

    def seen(self, other: _Target) -> _Target:
        """What a look at the same interval has shown."""
        self.inside, self.distinct, self.total, self.quantiles = other.inside, other.distinct, other.total, other.quantiles
        if self.rank >= self.before + self.inside and self.high is None:
            self.value = float("nan")
        return self

    def ends(self) -> tuple[float, float]:
        """The bracket around the rank that the sketch proposes."""
        at = (self.rank - self.before + 0.5) / self.inside
        low, high = math.floor((at - _AROUND) * _GRID), math.ceil((at + _AROUND) * _GRID)
        return self.quantiles[max(0, low)], self.quantiles[min(_GRID, high)]

    def holds(self) -> Column:
        value = F.col(self.column)
        held = value.isNotNull() & ~F.isnan(value)
        if self.low is not None:
            held = held & (value > self.low)
        return held if self.high is None else held & (value < self.high)


def _look(events: DataFrame, targets: list[_Target]) -> None:
    """Count and sketch what is inside the targets' intervals; ranks in one interval share the sketch."""
    spots = {(t.column, t.low, t.high): t for t in targets}
    columns = []
    for i, t in enumerate(spots.values()):
        value = F.when(t.holds(), F.col(t.column).cast("double"))
        columns += [F.count(t.column).alias(f"t{i}"), F.count(value).alias(f"n{i}"), F.approx_count_distinct(value).alias(f"d{i}"),
                    F.kll_sketch_agg_double(value, F.lit(_SKETCH_K)).alias(f"s{i}")]
    seen = events.agg(*columns)
    grid = F.array(*[F.lit(k / _GRID) for k in range(_GRID + 1)])
    row = seen.select(*[c for c in seen.columns if c[0] != "s"], *[
        F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", grid)).alias(f"q{i}") for i in range(len(spots))]).first()
    for i, t in enumerate(spots.values()):
        t.total, t.inside, t.distinct, t.quantiles = row[f"t{i}"], row[f"n{i}"], row[f"d{i}"], row[f"q{i}"]
    for t in targets:
        t.seen(spots[t.column, t.low, t.high])


def _narrow(events: DataFrame, targets: list[_Target]) -> None:
    """Move targets into the part of their interval, below, at or between the proposed ends, that holds the rank."""
    columns = []
    for i, t in enumerate(targets):
        value, (low, high) = F.col(t.column), t.ends()
        between = t.holds() & (value > low) & (value < high)
        columns += [F.count_if(t.holds() & (value < low)).alias(f"below{i}"), F.count_if(value == low).alias(f"low{i}"),
                    F.count_if(value == high).alias(f"high{i}"), F.count_if(between).alias(f"n{i}")]
    row = events.agg(*columns).first()
    for i, t in enumerate(targets):
        low, high = t.ends()
        rest = t.rank - t.before
        below, at_low, between = row[f"below{i}"], row[f"low{i}"], row[f"n{i}"]
        at_high = row[f"high{i}"] if high > low else 0
        if rest < below:
            t.high = low
        elif rest < below + at_low:
            t.value = low
        elif rest < below + at_low + between:
            t.low, t.high, t.before = low, high, t.before + below + at_low
        elif rest < below + at_low + between + at_high:
            t.value = high
        else:
            t.low, t.before = high, t.before + below + at_low + between + at_high


def _ordered(events: DataFrame, targets: list[_Target]) -> None:
    """Values of targets whose intervals hold few distinct ones; repeats are combined before the shuffle."""
    found = F.array_compact(F.array(*[
        F.when(t.holds(), F.struct(F.lit(i).alias("i"), F.col(t.column).cast("double").alias("value"))) for i, t in enumerate(targets)]))
    counts = events.select(F.inline(found)).groupBy("i", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("value"))
    wanted = F.element_at(F.array(*[F.lit(t.rank - t.before) for t in targets]), F.col("i") + 1)
    hits = counts.withColumn("upto", upto).filter((F.col("upto") > wanted) & (F.col("upto") - F.col("n") <= wanted))
    for row in hits.collect():
        targets[row["i"]].value = row["value"]


def values_at_ranks(events: DataFrame, ranks: dict[str, list[int]]) -> dict[str, list[float]]:
    """For each column the values at ranks from 0, ascending; NaN comes last, nulls do not count.

    Every rank must be below the number of values. Runs its scans when it is called; two for
    columns with few distinct values, and one more for each further factor of about twenty-five.
    """
    targets = [_Target(c, rank) for c, wanted in ranks.items() for rank in dict.fromkeys(wanted)]
    if targets:
        _look(events, targets)
        _search(events, targets)
    known = {(t.column, t.rank): t.value for t in targets}
    return {c: [known[c, rank] for rank in wanted] for c, wanted in ranks.items()}


def _search(events: DataFrame, targets: list[_Target]) -> None:
    """Find the values of targets that have been looked at."""
    while True:
        unknown = [t for t in targets if t.value is None]
        wide = [t for t in unknown if t.distinct > FEW]
        if not wide:
            break
        _narrow(events, wide)
        still = [t for t in wide if t.value is None]
        if still:
            _look(events, still)
    if unknown:
        _ordered(events, unknown)


def medians_of(events: DataFrame, *columns: str) -> dict[str, float | None]:
    """The exact median of each column: the mean of the two middle values; None for no value."""
    first = {c: _Target(c, 0) for c in columns}
    _look(events, list(first.values()))
    # The first look tells how many values there are, and serves their middle as well.
    targets = [_Target(c, rank).seen(t) for c, t in first.items() if t.total
               for rank in dict.fromkeys([(t.total - 1) // 2, t.total // 2])]
    if targets:
        _search(events, targets)
    middle = {c: [t.value for t in targets if t.column == c] for c in columns}
    return {c: sum(values) / len(values) if values else None for c, values in middle.items()}
