"""Running results of a stream of events: partial summaries, deduplication, pairs."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from temblor.operators.filters import mag_depth_pairs
from temblor.operators.retention import RetentionConfig
from temblor.plans.processors import (
    MEASURES, PROCESSORS, Measure, Processor, merge_summaries, summarize,
)
from temblor.plans.states import StateProcessor, merge_states, summarize_states
from temblor.plans.store import Store, read_store_summary, retain, take_in
from temblor.session import make_folder, paths_like
from temblor.streaming.ingest import ARRIVAL, IngestPaths, read_versions, write_batch



def start_first_versions(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = True, order: tuple[str, ...] = ("lastupdate",),
) -> StreamingQuery:
    """Pass each id once, whatever its times say; the first version to arrive wins.

    What has been seen is keyed state: for each id the first and the last batch that brought it. An id
    passes in the batch in which the two are the same. So a batch reads its own events and their keys'
    state, however long the history; no id is ever forgotten, as there is no watermark, and no event
    is late. A clock that is set back between two batches makes nothing pass twice.

    Of several versions inside one micro-batch that with the smallest ``order`` passes. The log of an
    ingest (``ingest.stream_versions``) tells the order of arrival, and a Kafka source its offset.
    Events without id all pass; each leaves a row of state. A batch that runs again replaces its own
    rows.
    """
    make_folder(events.sparkSession, path)
    rest = [c for c in events.columns if c not in (*order, "unid")]
    stamped = events.withColumn("_now", F.current_timestamp())
    # Nothing says that two events without an id are the same one, unless all of them is.
    stamped = stamped.withColumn("_lone", F.when(F.col("unid").isNull(), F.xxhash64("_now", *events.columns)))
    seen = stamped.groupBy("unid", "_lone").agg(
        F.min("_now").alias("_first"), F.max("_now").alias("_last"), F.min(F.struct(*order, *rest)).alias("_row"), F.count("*").alias("_n"))
    fresh = seen.filter(F.col("_first") == F.col("_last"))
    times = F.when(F.col("unid").isNull(), F.col("_n")).otherwise(1).cast("int")
    fresh = fresh.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select("unid", "_row.*").select(*events.columns)

    def write(batch: DataFrame, batch_id: int) -> None:
        # The log's own batch is not this stream's.
        write_batch(batch.drop("batch_id"), path, batch_id)

    writer = fresh.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_first_versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``start_first_versions`` passed; ``schema`` is that of the events."""
    stored = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(stored).parquet(path).drop("batch_id")


def start_summaries(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = True,
    processors: tuple[Processor, ...] = PROCESSORS, measures: Mapping[str, Measure] = MEASURES,
) -> StreamingQuery:
    """Write the partial summary of every micro-batch: all processors in one pass.

    Counts are those of the rows that arrive, so every row must be an event of its own. For
    messages with repeats and updates use ``refresh_summary``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(summarize(batch, processors, measures).hint("rebalance"), path, batch_id)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_states(
    events: DataFrame, path: str, checkpoint: str, processors: tuple[StateProcessor, ...], available_now: bool = True,
) -> StreamingQuery:
    """Write the states of every micro-batch; ``read_states`` merges them. As in ``start_summaries``,
    every row must be an event of its own; a store with ``states`` minds repeats and updates."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(summarize_states(batch, processors).hint("rebalance"), path, batch_id)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_states(spark: SparkSession, path: str, processors: tuple[StateProcessor, ...]) -> DataFrame:
    """The merged states of all micro-batches so far."""
    return merge_states(spark.read.parquet(path), processors)


def follow_log(
    spark: SparkSession, root: str, store: Store, on_update: str = "latest", upto: int | None = None,
    retention: RetentionConfig | None = None, as_of: datetime | None = None,
) -> int | None:
    """Take the batches of an ingest log that ``store`` has not seen into it, as one load; up to batch
    ``upto`` if it is given. Returns the last batch that the store holds now. With ``retention`` the
    store is cut to what is left at ``as_of`` after new batches.

    What is read is the new batches, the known versions of their ids and the cells that hold these. A
    run that broke off is repeated by the next one, whatever has arrived since.
    """
    seen = [int(p.rsplit("/", 1)[1]) for p in paths_like(spark, f"{store.root}/covered/*")]
    written = [int(p.rsplit("=", 1)[1]) for p in paths_like(spark, f"{IngestPaths(root).log}/batch_id=*")]
    done = max(seen, default=None)
    newest = max((b for b in written if upto is None or b <= upto), default=None)
    if newest is None or (done is not None and newest <= done):
        return done
    since = -1 if done is None else done
    new = read_versions(spark, root).filter(F.col("batch_id").between(since + 1, newest))
    if retention is not None and as_of is None:
        raise ValueError("retention needs as_of")
    take_in(spark, store, new, f"batches-{since + 1}", on_update, ARRIVAL)
    if retention is not None:
        retain(spark, store, as_of, retention)
    make_folder(spark, f"{store.root}/covered/{newest}")
    return newest


def refresh_summary(
    spark: SparkSession, root: str, path: str, on_update: str = "latest",
    processors: tuple[Processor, ...] = PROCESSORS, measures: Mapping[str, Measure] = MEASURES, upto: int | None = None,
) -> DataFrame:
    """The summary of the current events of an ingest log, brought up to date first.

    ``path`` is the root of a store (``plans.store``) beside the log. A batch adds its own parts; where
    it replaces known versions, only the cells that hold them are worked out again.
    """
    store = Store(path, processors, measures)
    follow_log(spark, root, store, on_update, upto)
    return read_store_summary(spark, store)


def compact_summaries(
    spark: SparkSession, source: str, target: str,
    processors: tuple[Processor, ...] = PROCESSORS, measures: Mapping[str, Measure] = MEASURES,
) -> None:
    """Merge the partial summaries written so far into one small table."""
    merge_summaries(spark.read.parquet(source), processors, measures).hint("rebalance").write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(target)


def start_pairs(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append magnitude and depth of every arriving event that has both."""
    writer = (
        mag_depth_pairs(events)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
