"""Message and table files that Spark derives from the given tables for stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from temblor.session import new_work_folder
from temblor.sources.event_table import write_events
from temblor.sources.messages import to_messages
from temblor.sources.quakes import read_quakes

FILES = 3
FILE_ROWS = 250_000  # events of a file at most, about; with more, a micro-batch takes more files

_LANDED: dict[tuple[str, str, str], str] = {}
_FILES: dict[tuple[str, str, str], int] = {}


def _landed(spark: SparkSession, kind: str, sf_dir: str, write) -> str:
    """Path of files written once per application and data folder."""
    key = (spark.sparkContext.applicationId, kind, sf_dir)
    if key not in _LANDED:
        path = new_work_folder(spark, kind)
        write(path)
        _LANDED[key] = path
    return _LANDED[key]


def files_of_batch(spark: SparkSession, sf_dir: str) -> int:
    """Files of a micro-batch: their number grows with the table, that of the micro-batches does not."""
    key = (spark.sparkContext.applicationId, "files", sf_dir)
    if key not in _FILES:
        events = read_quakes(spark, sf_dir).count()
        _FILES[key] = FILES * max(1, -(-events // (2 * FILES * FILE_ROWS)))
    return _FILES[key]


def _deal(frame: DataFrame, files: int) -> DataFrame:
    """Rows by their hash: rows that are dealt in turn are sorted first, which spills."""
    return frame.repartition(files, F.xxhash64(*frame.columns))


def _write_messages(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").option("compression", "gzip").text(path)


def updated(events: DataFrame) -> DataFrame:
    """The ``mb`` events once more, half a magnitude larger and an hour newer."""
    return events.filter(F.col("magtype") == "mb").withColumns(
        {"mag": F.col("mag") + 0.5, "lastupdate": F.col("lastupdate") + F.expr("interval '1' hour")}
    )


def repeated(events: DataFrame) -> DataFrame:
    """The ``Ms`` events once more, unchanged."""
    return events.filter(F.col("magtype") == "Ms")


def broken(events: DataFrame) -> DataFrame:
    """For each ``Md`` event a line that is no message."""
    return events.filter(F.col("magtype") == "Md").select(
        F.concat(F.lit('{"action":"create","data":{"id":"'), F.col("unid")).alias("value")
    )


def landed_messages(spark: SparkSession, sf_dir: str) -> str:
    """A landing folder: first every event, then updates, repeats and broken lines."""

    def write(path: str) -> None:
        quakes = read_quakes(spark, sf_dir)
        # A few files each, so that a stream over them takes several micro-batches.
        files = files_of_batch(spark, sf_dir)
        _write_messages(to_messages(_deal(quakes, 2 * files), "create"), path)
        late = (
            to_messages(updated(quakes), "update")
            .unionByName(to_messages(repeated(quakes), "create"))
            .unionByName(broken(quakes))
        )
        _write_messages(_deal(late, files), path)

    return _landed(spark, "messages", sf_dir, write)


def disorder(events: DataFrame) -> DataFrame:
    """Events that arrive after all others: of ``ML`` an older version, of ``Md`` one with the same
    ``lastupdate``, of ``Ms`` a new event two years back and one dated far ahead."""
    def moved(kind: str, unid: str, mag: float, interval: str) -> DataFrame:
        return events.filter(F.col("magtype") == kind).withColumns({
            "unid": F.concat(F.lit(unid), "unid"), "mag": F.col("mag") + mag,
            "lastupdate": F.col("lastupdate") + F.expr(f"interval '{interval}' day")})

    return moved("ML", "", 1.0, "-5").unionByName(moved("Md", "", -0.25, "0")).unionByName(
        moved("Ms", "L", 0.0, "-730")).unionByName(moved("Ms", "F", 0.0, "20000"))


def landed_disorder(spark: SparkSession, sf_dir: str) -> str:
    """A landing folder: first every event and those dated ahead, then the rest of ``disorder``."""

    def write(path: str) -> None:
        quakes = read_quakes(spark, sf_dir)
        late = disorder(quakes)
        ahead = F.col("unid").startswith("F")
        files = files_of_batch(spark, sf_dir)
        _write_messages(to_messages(_deal(quakes.unionByName(late.filter(ahead)), files), "create"), path)
        _write_messages(to_messages(_deal(late.filter(~ahead), files), "update"), path)

    return _landed(spark, "disorder", sf_dir, write)


def landed_table(spark: SparkSession, sf_dir: str) -> str:
    """The catalogue as a stored event table, one folder per date."""
    return _landed(
        spark, "events", sf_dir, lambda path: write_events(read_quakes(spark, sf_dir), path, True)
    )
