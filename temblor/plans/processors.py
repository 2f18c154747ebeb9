"""The mergeable summary: every processor's partial aggregates from one scan.

A processor names the keys it groups by. All processors are computed together with
``groupingSets``, so the events are read once, partial results are combined inside each
task and only small keyed rows are shuffled. Summaries of different batches are merged by
adding them up, which makes the same table serve batch runs and streams.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from temblor.functions.calendar import hour_number
from temblor.functions.geo import half_degree_key
from temblor.functions.magnitude import mag_key, magnitude_to_energy


@dataclass(frozen=True)
class Processor:
    """A grouping of the events: ``keys`` maps a key column to its expression.

    ``section`` may turn the processor's part of the summary into a table for the report,
    where it appears under ``title``.
    """

    name: str
    keys: Mapping[str, Callable[[], Column]]
    title: str | None = None
    section: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Measure:
    """A mergeable aggregate: ``partial`` over the ``value`` of each row, then ``merge``."""

    value: Callable[[], Column]
    partial: Callable[[str], Column]
    merge: Callable[[str], Column]


MAGNITUDE = Processor("magnitude", {"mag_key": lambda: mag_key(F.col("mag"))})
CALENDAR = Processor("calendar", {"hour_number": lambda: hour_number(F.col("time"))})
REGION = Processor("region", {"flynn_region": lambda: F.col("flynn_region")})
GRID = Processor(
    "grid",
    {
        "lat_key": lambda: half_degree_key(F.col("lat")),
        "lon_key": lambda: half_degree_key(F.col("lon")),
    },
)

# Histogram, fit and risk share the magnitude bins; pairs need no aggregate.
PROCESSORS = (MAGNITUDE, CALENDAR, REGION, GRID)


def _timed() -> Column:
    return F.col("mag").isNotNull() & F.col("time").isNotNull()


def _located() -> Column:
    return F.col("flynn_region").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()


def _mag_energy() -> Column:
    return F.when(_timed(), magnitude_to_energy(F.col("mag")))


def _timed_time() -> Column:
    return F.when(_timed(), F.col("time"))


MEASURES: dict[str, Measure] = {
    "n": Measure(lambda: F.lit(1), F.count, F.sum),
    "n_mag": Measure(lambda: F.col("mag"), F.count, F.sum),
    "sum_mag": Measure(lambda: F.col("mag"), F.sum, F.sum),
    "n_depth": Measure(lambda: F.col("depth"), F.count, F.sum),
    "sum_depth": Measure(lambda: F.col("depth"), F.sum, F.sum),
    "n_located": Measure(_located, F.count_if, F.sum),
    "n_timed": Measure(_timed, F.count_if, F.sum),
    "energy": Measure(_mag_energy, F.sum, F.sum),
    "first_time": Measure(_timed_time, F.min, F.min),
    "last_time": Measure(_timed_time, F.max, F.max),
    "last_update": Measure(lambda: F.col("lastupdate"), F.max, F.max),
}


# Sketches of all values, for running medians; in a store of its own, as each cell has one of each.
WHOLE = Processor("whole", {"whole": lambda: F.lit(0)})
QUANTILES: dict[str, Measure] = {
    "n": MEASURES["n"],
    "mag_values": Measure(lambda: F.col("mag"), F.kll_sketch_agg_double, F.kll_merge_agg_double),
    "depth_values": Measure(lambda: F.col("depth"), F.kll_sketch_agg_double, F.kll_merge_agg_double),
}


def key_columns(processors: tuple[Processor, ...]) -> list[str]:
    return [key for p in processors for key in p.keys]


def summarize(
    events: DataFrame,
    processors: tuple[Processor, ...] = PROCESSORS,
    measures: Mapping[str, Measure] = MEASURES,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """(processor, keys..., measures...) of a set of events. Keys of other processors are null.

    With ``by``, columns of ``events``, there is a summary for each of their values, which stand
    behind the measures.
    """
    keys = key_columns(processors)
    if len(set(keys)) != len(keys):
        raise ValueError("processors must not share a key column")
    # Keys and measure inputs are worked out once per event, before the rows are expanded
    # to one per processor.
    keyed = events.select(
        *[expr().alias(key) for p in processors for key, expr in p.keys.items()],
        *[m.value().alias(f"_{name}") for name, m in measures.items()],
        *by,
    )
    totals = keyed.groupingSets([[*by, *p.keys] for p in processors], *by, *keys).agg(
        F.grouping_id().alias("_set"),
        *[m.partial(f"_{name}").alias(name) for name, m in measures.items()],
    )
    # grouping_id has a 0 bit for each key that is grouped by, first key highest.
    name = F.lit(None).cast("string")
    for p in processors:
        bits = "".join("0" if key in p.keys else "1" for key in keys)
        name = F.when(F.col("_set") == int(bits, 2), p.name).otherwise(name)
    return totals.select(name.alias("processor"), *keys, *measures, *by)


def merge_summaries(
    partials: DataFrame,
    processors: tuple[Processor, ...] = PROCESSORS,
    measures: Mapping[str, Measure] = MEASURES,
) -> DataFrame:
    """One summary of any number of partial ones."""
    return partials.groupBy("processor", *key_columns(processors)).agg(
        *[m.merge(name).alias(name) for name, m in measures.items()]
    )


def part(
    summary: DataFrame, processor: Processor, measures: Mapping[str, Measure] = MEASURES
) -> DataFrame:
    """The rows of one processor with its own keys and the measures."""
    kept = [name for name in measures if name in summary.columns]
    return summary.filter(F.col("processor") == processor.name).select(*processor.keys, *kept)
