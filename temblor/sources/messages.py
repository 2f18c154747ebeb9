"""Live messages ``{action, data}``: parsing, reading and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from temblor.schema import MESSAGE_ACTIONS, MESSAGE_SCHEMA
from temblor.sources.geojson import feature_columns, feature_json, parsed_once


def parse_messages(lines: DataFrame, text: str = "value") -> DataFrame:
    """Adds ``action``, the event columns and ``error`` to raw message texts.

    Works on batch and streaming frames. A bad message is marked, never dropped.
    """
    parsed = parsed_once(lines, text, MESSAGE_SCHEMA, "_m")
    *columns, error = feature_columns("_m.data", "_m._corrupt_record")
    known = F.coalesce(F.col("_m.action").isin(*MESSAGE_ACTIONS), F.lit(False))
    return parsed.select(
        *lines.columns,
        F.col("_m.action").alias("action"),
        *columns,
        F.when(~known, "bad or missing: action").otherwise(error).alias("error"),
    )


def accepted(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("error").isNull()).drop("error")


def rejected(messages: DataFrame, text: str = "value") -> DataFrame:
    return messages.filter(F.col("error").isNotNull()).select(text, "error")


def read_event_messages(spark: SparkSession, path: str) -> DataFrame:
    """All messages below ``path``, one per line, as a batch."""
    return parse_messages(spark.read.text(path))


def stream_event_messages(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """The same as a stream over a landing folder."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_messages(reader.text(path))


def stream_kafka_messages(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The same from a Kafka topic; needs Spark's Kafka package on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return parse_messages(raw.select(F.col("value").cast("string").alias("value")))


def to_messages(events: DataFrame, action: str | Column, text: str = "value") -> DataFrame:
    """Message texts for events; ``action`` is a constant or a column of ``events``."""
    label = F.lit(action) if isinstance(action, str) else action
    return events.select(
        F.concat(
            F.lit('{"action":"'), label, F.lit('","data":'), feature_json(), F.lit("}")
        ).alias(text)
    )
