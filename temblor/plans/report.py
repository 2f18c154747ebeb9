"""The seven-section report and its JSON forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from temblor.operators import geo, stats
from temblor.plans import summary as from_summary
from temblor.plans.processors import (
    CALENDAR,
    MAGNITUDE,
    MEASURES,
    REGION,
    Processor,
    part,
    summarize,
)
from temblor.session import shared_folder

# Section titles in report order.
SECTION_TITLES = (
    "Magnitude Statistics",
    "Temporal Patterns Analysis",
    "Depth Statistics",
    "Geographic Hotspots",
    "Gutenberg-Richter Analysis",
    "Risk Assessment",
    "Regional Analysis",
)


# What the sections need; positions and update times stay unread.
_USED_MEASURES = (
    "n", "n_mag", "sum_mag", "n_depth", "sum_depth", "n_timed", "energy", "first_time", "last_time"
)


def section_json(section: DataFrame, *order: Column) -> DataFrame:
    """One row ``data``: ``{}`` for no rows, an object for one, otherwise an array.

    For small finished tables only: all rows end up in one value. ``order`` sorts the
    array; give negated numbers for a descending order.
    """
    keep_nulls = {"ignoreNullFields": "false"}
    rows = F.transform(
        F.array_sort(
            F.collect_list(
                F.struct(
                    *[column.alias(f"_{i}") for i, column in enumerate(order)],
                    F.struct(*section.columns).alias("row"),
                )
            )
        ),
        lambda item: item.row,
    )
    return section.agg(F.count("*").alias("n"), rows.alias("rows")).select(
        F.when(F.col("n") == 0, "{}")
        .when(F.col("n") == 1, F.to_json(F.get("rows", F.lit(0)), keep_nulls))
        .otherwise(F.to_json("rows", keep_nulls))
        .alias("data")
    )


def report_sections(summary: DataFrame, column_stats: DataFrame) -> dict[str, tuple]:
    """Section table and sort columns by title, in report order."""
    regions = geo.top_regions(from_summary.region_stats(summary))
    by_count = (-F.col("event_count"), F.col("flynn_region"))
    tables = (
        (stats.stats_row(column_stats, "mag", "magnitude"),),
        (from_summary.temporal_section(summary), F.col("date")),
        (stats.stats_row(column_stats, "depth", "depth"),),
        (regions.drop("avg_depth"), *by_count),
        (from_summary.gr_section(summary),),
        (from_summary.risk_section(summary),),
        (regions, *by_count),
    )
    return dict(zip(SECTION_TITLES, tables))


def advanced_analytics(events: DataFrame, extra: tuple[Processor, ...] = ()) -> DataFrame:
    """(seq, title, data) of the seven sections, then those of ``extra`` processors.

    The events are read twice: once for the summary and once for the exact medians. Both
    intermediate results are small. They are checkpointed to the shared folder, because
    several sections start from them and must not each start a scan.
    """
    shared_folder(events.sparkSession)
    processors = (MAGNITUDE, CALENDAR, REGION, *extra)
    measures = {name: MEASURES[name] for name in _USED_MEASURES}
    summary = summarize(events, processors, measures).checkpoint()
    column_stats = stats.column_stats(events, "mag", "depth").checkpoint()
    sections = report_sections(summary, column_stats)
    for processor in extra:
        if processor.section is not None:
            table = processor.section(part(summary, processor))
            sections[processor.title or processor.name] = (table, *map(F.col, table.columns))
    rows = [
        section_json(table, *order).select(
            F.lit(seq).alias("seq"), F.lit(title).alias("title"), "data"
        )
        for seq, (title, (table, *order)) in enumerate(sections.items(), start=1)
    ]
    return reduce(DataFrame.unionByName, rows)


def report_json(report: DataFrame) -> DataFrame:
    """The report as one JSON text ``{"stats":[{"title":...,"data":...}]}``."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "title", "data")))

    def entry(item: Column) -> Column:
        titled = F.to_json(F.struct(item.title.alias("title")))
        return F.concat(F.regexp_replace(titled, r"\}$", ""), F.lit(',"data":'), item.data, F.lit("}"))

    return report.agg(ordered.alias("items")).select(
        F.concat(
            F.lit('{"stats":['),
            F.array_join(F.transform("items", entry), ","),
            F.lit("]}"),
        ).alias("report")
    )
