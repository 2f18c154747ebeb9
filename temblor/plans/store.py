"""A catalogue with its summary, both kept up to date load by load.

Events are partitioned by UTC date and by the load that brought them; such a partition is a cell. The
summary has a part for every cell. A load writes its own cells and their parts. If it replaces
versions that the catalogue already has, the cells which hold them are written again without them,
and only their parts are worked out anew, so no sum, minimum or maximum has to be taken back. What
is read is the load, the ids in question and the touched cells, however long the history.

Where an id is, is told by an index in ``ID_BUCKETS`` parts by hash: a small load opens a few of them.
Index rows may be out of date, as a cell's rows are looked at before anything is decided.

A load that is run again replaces its own cells, so loads may be repeated after a crash. An unfinished
load leaves a mark; until it is run again, no other change is accepted. There is one writer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from temblor.functions.calendar import DATE_COLUMN, time_within, utc_date, utc_literal
from temblor.functions.magnitude import mag_key
from temblor.operators.ordering import newest_events, page
from temblor.operators.quality import check_events
from temblor.operators.retention import RetentionConfig
from temblor.operators.versions import SMALL_BATCH, current_events
from temblor.plans.processors import (
    CALENDAR, MAGNITUDE, MEASURES, PROCESSORS, Measure, Processor, merge_summaries, summarize,
)
from temblor.plans.states import StateProcessor, merge_states, summarize_states
from temblor.schema import EVENT_COLUMNS, EVENT_SCHEMA
from temblor.session import make_folder, paths_like, remove_path, settle
from temblor.sources.geojson import empty_events

ID_BUCKETS = 64
LOAD_COLUMN = "load"
_CELL = (DATE_COLUMN, LOAD_COLUMN)
_CELL_FIELDS = [T.StructField(DATE_COLUMN, T.DateType()), T.StructField(LOAD_COLUMN, T.StringType())]
_EVENTS = T.StructType([*EVENT_SCHEMA.fields, *_CELL_FIELDS])
_IDS = T.StructType([T.StructField("unid", T.StringType()), T.StructField(DATE_COLUMN, T.DateType()),
                     T.StructField("bucket", T.IntegerType()), T.StructField(LOAD_COLUMN, T.StringType())])
_NO_DATE = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Store:
    """Folders below one root in storage that all executors share, and what the summary holds."""

    root: str
    processors: tuple[Processor, ...] = PROCESSORS
    measures: Mapping[str, Measure] = None
    states: tuple[StateProcessor, ...] = ()

    def __post_init__(self):
        if self.measures is None:
            object.__setattr__(self, "measures", MEASURES)

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    @property
    def summary(self) -> str:
        return f"{self.root}/summary"

    @property
    def state_parts(self) -> str:
        return f"{self.root}/states"

    @property
    def by_cell(self) -> tuple[str, ...]:
        """The folders that are partitioned by cell: the events and what is worked out from them."""
        return (self.events, self.summary, *([self.state_parts] if self.states else []))

    @property
    def ids(self) -> str:
        return f"{self.root}/ids"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    @property
    def unfinished(self) -> str:
        return f"{self.root}/unfinished"

    def summarize(self, cells: DataFrame) -> DataFrame:
        return summarize(cells, self.processors, self.measures, _CELL)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    make_folder(spark, path)
    return spark.read.schema(schema).parquet(path)


def read_cells(spark: SparkSession, store: Store) -> DataFrame:
    """The events with ``event_date`` and ``load``."""
    return _read(spark, store.events, _EVENTS)


def read_store(spark: SparkSession, store: Store, with_date: bool = False) -> DataFrame:
    """The events; with ``event_date`` time filters skip whole dates."""
    return read_cells(spark, store).select(*EVENT_COLUMNS, *([DATE_COLUMN] if with_date else []))


def read_parts(spark: SparkSession, store: Store) -> DataFrame:
    """The summary by cell."""
    return _read(spark, store.summary, store.summarize(_no_cells(spark)).schema)


def read_store_summary(spark: SparkSession, store: Store) -> DataFrame:
    """The summary of all events."""
    return merge_summaries(read_parts(spark, store).drop(*_CELL), store.processors, store.measures)


def read_store_states(spark: SparkSession, store: Store) -> DataFrame:
    """The states of all events, one row for each key."""
    parts = _read(spark, store.state_parts, summarize_states(_no_cells(spark), store.states, _CELL).schema)
    return merge_states(parts.drop(*_CELL), store.states)


def _no_cells(spark: SparkSession) -> DataFrame:
    return empty_events(spark).withColumns({DATE_COLUMN: F.lit(None).cast("date"), LOAD_COLUMN: F.lit("")})


def take_in(spark: SparkSession, store: Store, events: DataFrame, load: str, on_update: str = "first",
            arrival: tuple[str, ...] = (), check: bool = False) -> None:
    """Take a batch of parsed events into the store as load ``load``.

    ``first`` lets an id in once, and not at all if another load brought it; ``latest`` lets a newer or
    equally new version replace the known one; ``all`` takes every row. ``arrival`` names the columns
    of the order of arrival inside the batch. Events without id all come in. With ``check`` events
    that break a rule are set aside in ``rejects`` with their errors.

    Running a load again replaces what it brought before. It changes nothing if the batch is the same
    and no other load has brought its ids since. An empty batch leaves no cells.
    """
    if on_update not in ("first", "latest", "all"):
        raise ValueError("on_update must be 'first', 'latest' or 'all'")
    if not re.fullmatch(r"[A-Za-z0-9_]+(-[A-Za-z0-9_]+)*", load):
        raise ValueError("a load is named by letters, digits, _ and single - between them")
    _open(spark, store, load)
    for folder, depth in (*[(f, "*") for f in store.by_cell], (store.ids, "*"), (store.rejects, "")):
        for path in paths_like(spark, "/".join(filter(None, (folder, depth, f"{LOAD_COLUMN}={load}")))):
            remove_path(spark, path)
    if check:
        checked = settle(check_events(events))
        bad = checked.filter(F.size("errors") > 0).withColumn(LOAD_COLUMN, F.lit(load))
        bad.write.mode("append").partitionBy(LOAD_COLUMN).parquet(store.rejects)
        events = checked.filter(F.size("errors") == 0).drop("errors")

    fresh = events.select(*EVENT_COLUMNS) if on_update == "all" else current_events(events, on_update, arrival)
    fresh = settle(fresh.withColumns({DATE_COLUMN: utc_date(F.col("time")), LOAD_COLUMN: F.lit(load)}))
    touched: list[str] = []
    if on_update != "all":
        fresh, replaced, touched = _resolve(spark, store, fresh, on_update)
    # The index comes first: no row of the store is ever unknown to it.
    _write_ids(store, fresh)
    _write_cells(store.events, fresh)
    changed = fresh
    if touched:
        left = settle(_cells_named(spark, store, touched).join(replaced, "unid", "left_anti"))
        _replace_cells(spark, store, left, touched)
        changed = fresh.unionByName(left)
    _write_parts(store, changed)
    _close(spark, store, load)


def _resolve(spark: SparkSession, store: Store, fresh: DataFrame, on_update: str) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """(rows that come in, ids whose known version goes, names of the cells that hold these)."""
    ids = fresh.filter(F.col("unid").isNotNull()).select("unid", _bucket())
    few = ids.count() <= SMALL_BATCH
    send = F.broadcast if few else (lambda frame: frame)
    # At most ID_BUCKETS numbers; the other parts of the index are not opened.
    buckets = [r["bucket"] for r in ids.select("bucket").distinct().collect()]
    index = _read(spark, store.ids, _IDS).filter(F.col("bucket").isin(buckets))
    places = settle(index.join(send(ids.select("unid")), "unid", "left_semi").select(_name().alias("cell")).distinct())
    names = [r["cell"] for r in places.collect()]  # partitions, not rows
    if not names:
        return fresh, None, []
    known = _cells_named(spark, store, names).join(send(ids.select("unid")), "unid", "left_semi")
    known = settle(known.select("unid", "lastupdate", _name().alias("cell")))
    if on_update == "first":
        return settle(fresh.join(known.select("unid").distinct(), "unid", "left_anti").select(*fresh.columns)), None, []
    held = known.groupBy("unid").agg(F.max("lastupdate").alias("_held"), F.lit(True).alias("_known"))
    judged = fresh.join(held, "unid", "left")
    judged = settle(judged.filter(F.col("_held").isNull() | (F.col("lastupdate") >= F.col("_held"))))
    replaced = judged.filter("_known").select("unid")
    touched = [r["cell"] for r in known.join(replaced, "unid", "left_semi").select("cell").distinct().collect()]
    return judged.select(*fresh.columns), replaced, touched


def _name() -> Column:
    """A cell's name for partition filters."""
    return F.concat_ws("/", F.coalesce(F.col(DATE_COLUMN).cast("string"), F.lit("-")), F.col(LOAD_COLUMN))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("unid"), F.lit(ID_BUCKETS)).cast("int").alias("bucket")


def _cells_named(spark: SparkSession, store: Store, names: list[str]) -> DataFrame:
    """Only the partitions of these cells are opened."""
    return read_cells(spark, store).filter(_name().isin(names))


def _write_cells(path: str, frame: DataFrame) -> None:
    """Write whole cells, each in place of what it held. A busy date is split over tasks."""
    # The cell comes first, or the writer would sort all rows by it once more.
    order = [c for c in (*_CELL, "time") if c in frame.columns]
    frame.hint("rebalance", DATE_COLUMN).sortWithinPartitions(*order).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*_CELL).parquet(path)


def _write_parts(store: Store, cells: DataFrame) -> None:
    """Work out the summary and the states of whole cells."""
    _write_cells(store.summary, store.summarize(cells))
    if store.states:
        _write_cells(store.state_parts, summarize_states(cells, store.states, _CELL))


def _write_ids(store: Store, cells: DataFrame) -> None:
    rows = cells.filter(F.col("unid").isNotNull()).select("unid", DATE_COLUMN, _bucket(), LOAD_COLUMN)
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", LOAD_COLUMN, "unid").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket", LOAD_COLUMN).parquet(store.ids)


def _replace_cells(spark: SparkSession, store: Store, left: DataFrame, names: list[str]) -> None:
    """Put ``left``, settled, in place of the cells ``names``; those without a row go with their parts."""
    _write_cells(store.events, left)
    there = {r["cell"] for r in left.select(_name().alias("cell")).distinct().collect()}
    for name in set(names) - there:
        day, load = name.rsplit("/", 1)
        for folder in store.by_cell:
            remove_path(spark, f"{folder}/{DATE_COLUMN}={_NO_DATE if day == '-' else day}/{LOAD_COLUMN}={load}")


def _open(spark: SparkSession, store: Store, load: str) -> None:
    others = [p for p in paths_like(spark, f"{store.unfinished}/*") if not p.endswith(f"/{load}")]
    if others:
        raise RuntimeError(f"a change was not finished, run it again first: {', '.join(p.rsplit('/', 1)[1] for p in others)}")
    make_folder(spark, f"{store.unfinished}/{load}")


def _close(spark: SparkSession, store: Store, load: str) -> None:
    remove_path(spark, f"{store.unfinished}/{load}")


def dates_of(spark: SparkSession, store: Store) -> list[tuple[date | None, int]]:
    """(date, events), newest first and events without a time last, from the files' footers."""
    counts = read_cells(spark, store).groupBy(DATE_COLUMN).agg(F.count(F.lit(1)).alias("n"))
    return [(r[DATE_COLUMN], r["n"]) for r in counts.orderBy(F.desc_nulls_last(DATE_COLUMN)).collect()]


def retain(spark: SparkSession, store: Store, as_of: datetime, config: RetentionConfig) -> None:
    """Remove what is too old at ``as_of`` and then what is beyond the newest ``max_events``.

    Whole dates go by their folders; only the dates that hold a boundary are read and written again,
    and only their parts of the summary worked out anew. Files of all other dates stay as they are.
    With a rule of age, events without a time go. Running it again after a crash finishes it.
    """
    if not config.auto_cleanup:
        return
    _open(spark, store, "retention")
    days = dates_of(spark, store)
    if config.retention_days > 0:
        cutoff = config.cutoff(as_of)
        limit = spark.range(1).select(utc_date(utc_literal(cutoff)).alias("d")).first()["d"]
        gone = [d for d, _ in days if d is None or d < limit]
        _drop_dates(spark, store, gone)
        if any(d == limit for d, _ in days):
            _rewrite_date(spark, store, limit, lambda cells: cells.filter(
                time_within(cells.columns, at_least=utc_literal(cutoff))))
        days = dates_of(spark, store)
    if config.max_events > 0:
        room, gone = config.max_events, []
        for day, n in days:
            if room <= 0:
                gone.append(day)
            elif n > room:
                _rewrite_date(spark, store, day, lambda cells, k=room: newest_events(cells, k))
            room -= n
        _drop_dates(spark, store, gone)
    _close(spark, store, "retention")


def _drop_dates(spark: SparkSession, store: Store, days: list[date | None]) -> None:
    for day in days:
        for folder in store.by_cell:
            remove_path(spark, f"{folder}/{DATE_COLUMN}={day or _NO_DATE}")


def _rewrite_date(spark: SparkSession, store: Store, day: date | None, keep) -> None:
    cells = read_cells(spark, store).filter(F.col(DATE_COLUMN).eqNullSafe(F.lit(day).cast("date")))
    names = [r["cell"] for r in cells.select(_name().alias("cell")).distinct().collect()]
    left = settle(keep(cells).select(*cells.columns))
    _replace_cells(spark, store, left, names)
    _write_parts(store, left)


def store_page(spark: SparkSession, store: Store, order: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` of an order, as ``ordering.page`` gives them.

    The summary is the index: its counts by hour, or by tenth of a magnitude, tell between which keys
    the page lies and how many rows are ahead. Only the rows between are counted further; for an
    order by time, no other date is opened. One small job finds the ends.
    """
    events = read_store(spark, store, with_date=True)
    by_time = order.startswith("time")
    processor = CALENDAR if by_time else MAGNITUDE
    if processor not in store.processors or "n" not in store.measures:
        return page(events, order, limit, offset).select(*EVENT_COLUMNS)
    key = next(iter(processor.keys))
    rows = read_parts(spark, store).filter((F.col("processor") == processor.name) & F.col(key).isNotNull())
    # NaN, the largest magnitude, is counted with the smallest.
    odd = F.lit(False) if by_time or "sum_mag" not in store.measures else F.isnan("sum_mag")
    counts = rows.groupBy(key).agg(F.sum("n").alias("n"), F.max(odd).alias("odd"))
    # Hours or tenths: a number of rows that does not grow with the events of a time.
    along = F.desc(key) if order in ("time", "magnitude") else F.asc(key)
    placed = counts.withColumn("upto", F.sum("n").over(Window.orderBy(along)))
    start, end = F.col("upto") > offset, F.col("upto") >= offset + limit
    found = placed.agg(
        F.min_by(key, F.when(start, F.col("upto"))).alias("first"), F.min(F.when(start, F.col("upto") - F.col("n"))).alias("ahead"),
        F.min_by(key, F.when(end, F.col("upto"))).alias("last"), F.max("odd").alias("odd")).first()
    if found["ahead"] is None or found["last"] is None or found["odd"] or (not by_time and "sum_mag" not in store.measures):
        # The page reaches rows without a key.
        return page(events, order, limit, offset).select(*EVENT_COLUMNS)
    low, high = sorted((found["first"], found["last"]))
    if by_time:
        hour = 3_600_000_000
        near = time_within(events.columns, at_least=F.timestamp_micros(F.lit(low * hour)), before=F.timestamp_micros(F.lit((high + 1) * hour)))
    else:
        near = mag_key(F.col("mag")).between(low, high)
    return page(events.filter(near), order, limit, offset - found["ahead"]).select(*EVENT_COLUMNS)


def merge_loads(spark: SparkSession, store: Store, into: str, most: int = 8) -> None:
    """Write dates that have cells of more than ``most`` loads as one cell each, of load ``into``.

    Many small loads leave many small files. A load that was merged cannot be replaced any more.
    """
    _open(spark, store, into)
    cells = read_cells(spark, store)
    loads = cells.select(*_CELL).distinct().groupBy(DATE_COLUMN).agg(F.count(F.lit(1)).alias("n"), F.collect_list(LOAD_COLUMN).alias("loads"))
    for row in loads.filter(F.col("n") > most).collect():  # dates, not rows
        day = row[DATE_COLUMN]
        whole = settle(cells.filter(F.col(DATE_COLUMN).eqNullSafe(F.lit(day).cast("date"))).withColumn(LOAD_COLUMN, F.lit(into)))
        _write_ids_again(store, whole)
        _write_cells(store.events, whole)
        _write_parts(store, whole)
        for load in set(row["loads"]) - {into}:
            for folder in store.by_cell:
                remove_path(spark, f"{folder}/{DATE_COLUMN}={day or _NO_DATE}/{LOAD_COLUMN}={load}")
    _close(spark, store, into)


def _write_ids_again(store: Store, cells: DataFrame) -> None:
    """Add index rows of a load that may have some already; repeats do no harm."""
    rows = cells.filter(F.col("unid").isNotNull()).select("unid", DATE_COLUMN, _bucket(), LOAD_COLUMN)
    rows.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket", LOAD_COLUMN).parquet(store.ids)


def rebuild(spark: SparkSession, store: Store) -> None:
    """Work out the whole summary and the index from the events, in one pass each."""
    _open(spark, store, "rebuild")
    cells = read_cells(spark, store)
    for path in (*store.by_cell[1:], store.ids):
        remove_path(spark, path)
    _write_ids(store, cells)
    _write_parts(store, cells)
    _close(spark, store, "rebuild")


def clear(spark: SparkSession, store: Store) -> None:
    """Leave an empty store; unfinished changes end here as well."""
    remove_path(spark, store.root)
    for path in (*store.by_cell, store.ids):
        make_folder(spark, path)
