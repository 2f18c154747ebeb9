"""Live messages into the version log, with bad messages set aside.

Every micro-batch writes its own ``batch_id`` partition and replaces it when it is run
again, so a restart neither loses nor repeats rows. The stream keeps no state: repeats and
updates are resolved when the log is read (``read_current``). The log holds the order of arrival:
``batch_id``, and within a batch ``sequence``, the order in which Spark reads the source's files
or partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from temblor.operators.quality import event_errors
from temblor.operators.versions import current_events, upsert_events
from temblor.schema import EVENT_COLUMNS, EVENT_SCHEMA
from temblor.sources.event_table import read_events, write_events
from temblor.sources.messages import accepted, rejected, to_messages

Emit = Callable[[DataFrame, int], None]

_LOG_SCHEMA = T.StructType(
    [T.StructField("action", T.StringType()), *EVENT_SCHEMA.fields,
     T.StructField("sequence", T.LongType()), T.StructField("batch_id", T.LongType())]
)
ARRIVAL = ("batch_id", "sequence")
_REJECT_SCHEMA = "value STRING, error STRING, batch_id BIGINT"


@dataclass(frozen=True)
class IngestPaths:
    """Folders below one root in storage that all executors share."""

    root: str

    @property
    def log(self) -> str:
        return f"{self.root}/versions"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    @property
    def emitted(self) -> str:
        return f"{self.root}/emitted"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def write_batch(frame: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch as partition ``batch_id``, replacing an earlier attempt."""
    (
        frame.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("batch_id")
        .parquet(path)
    )


def start_ingest(
    messages: DataFrame,
    root: str,
    emit: Emit | None = None,
    available_now: bool = True,
    check_ranges: bool = False,
) -> StreamingQuery:
    """Run parsed messages into log, rejects and, for subscribers, emitted messages.

    With ``check_ranges`` a message whose event breaks a range rule is set aside as well.

    ``emit`` gets the accepted messages of each batch as text, with the batch id, and may
    send them anywhere; a batch can come twice after a restart. By default they are written
    to the ``emitted`` folder.
    """
    paths = IngestPaths(root)

    def to_folder(sent: DataFrame, batch_id: int) -> None:
        write_batch(sent, paths.emitted, batch_id)

    send = emit or to_folder

    def write(batch: DataFrame, batch_id: int) -> None:
        if check_ranges:
            broken = F.array_join(event_errors(), ",")
            batch = batch.withColumn("error", F.coalesce("error", F.when(broken != "", broken)))
        # Three outputs from one parse of the batch. Only a bad message's text is needed again.
        batch = batch.withColumn("value", F.when(F.col("error").isNotNull(), F.col("value")))
        batch = batch.withColumn("sequence", F.monotonically_increasing_id()).persist()
        try:
            good = accepted(batch).select("action", *EVENT_COLUMNS, "sequence")
            write_batch(good, paths.log, batch_id)
            write_batch(rejected(batch), paths.rejects, batch_id)
            send(to_messages(good.drop("sequence"), F.col("action")), batch_id)
        finally:
            batch.unpersist()

    writer = messages.writeStream.foreachBatch(write).option(
        "checkpointLocation", paths.checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_versions(spark: SparkSession, root: str, since: int | None = None) -> DataFrame:
    """Every accepted version, with ``action`` and order of arrival, or those after batch ``since``."""
    log = spark.read.schema(_LOG_SCHEMA).parquet(IngestPaths(root).log)
    return log if since is None else log.filter(F.col("batch_id") > since)


def stream_versions(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """The version log as a stream: parsed already, and in the order of arrival by ``ARRIVAL``."""
    stream = spark.readStream.schema(_LOG_SCHEMA)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(IngestPaths(root).log)


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_REJECT_SCHEMA).parquet(IngestPaths(root).rejects)


def read_emitted(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("value STRING, batch_id BIGINT").parquet(IngestPaths(root).emitted)


def read_current(spark: SparkSession, root: str, on_update: str = "latest") -> DataFrame:
    """One row per event id: the newest version, or the first one to arrive."""
    return current_events(read_versions(spark, root), on_update, ARRIVAL)


def compact(
    spark: SparkSession,
    root: str,
    table: str,
    on_update: str = "latest",
    base: str | None = None,
    since: int | None = None,
) -> None:
    """Write the current events as a date-partitioned table for fast reports.

    With ``base``, an earlier result at another path, only the log after batch ``since`` is
    read, and only its ids are resolved; older batches may then be removed from the log.
    """
    versions = read_versions(spark, root, since)
    if base is None:
        current = current_events(versions, on_update, ARRIVAL)
    else:
        current = upsert_events(read_events(spark, base), versions, on_update, ARRIVAL)
    write_events(current, table, clear=True)
