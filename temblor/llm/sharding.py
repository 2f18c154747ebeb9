"""Shards from a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from temblor.llm.graph import settle

ROUNDS = 6


def _round_value(half: np.ndarray, key: int) -> np.ndarray:
    x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(1, 2**62, ROUNDS)]


def permute(rows: np.ndarray, total: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The place of each row number below ``total``, or the row number of each place.

    The network permutes the numbers below the next power of four; a value at or above ``total`` is
    sent through it again until it falls below, which takes less than four passes on average.
    """
    half_bits = 1
    while 4**half_bits < total:
        half_bits += 1
    bits, mask = np.uint64(half_bits), np.uint64(2**half_bits - 1)
    keys = _keys(seed)
    out = rows.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        if inverse:
            for key in reversed(keys):
                left, right = right ^ (_round_value(left, key) & mask), left
        else:
            for key in keys:
                left, right = right, left ^ (_round_value(right, key) & mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def shard_of(row: int, total: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one global row number, without reading any data."""
    place = int(permute(np.array([row]), total, seed)[0])
    return place % shards, place // shards


def row_of(shard: int, slot: int, total: int, shards: int, seed: int = 0) -> int:
    """The global row number in one slot."""
    return int(permute(np.array([slot * shards + shard]), total, seed, inverse=True)[0])


def number_rows(frame: DataFrame, keys: list[str], name: str = "row_number", buckets: int = 4096) -> tuple[DataFrame, int]:
    """(frame with the global row number, rows): rows by bucket of the key hash, then by the keys.

    A bucket holds one ``buckets``-th of the keys; numbers run through the buckets in turn. Only the
    row count of each bucket meets in one place. Rows that are equal in all keys are
    interchangeable; they take consecutive numbers.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    marked = frame.withColumn("_bucket", bucket)
    counts = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).collect()  # at most ``buckets`` rows
    total, base = 0, {}
    for row in sorted(counts, key=lambda r: r["_bucket"]):
        base[row["_bucket"]] = total
        total += row["_n"]
    spark = frame.sparkSession
    bases = spark.createDataFrame(sorted(base.items()), "_bucket bigint, _base bigint")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    numbered = marked.withColumn("_inside", inside).join(F.broadcast(bases), "_bucket").withColumn(
        name, F.col("_base") + F.col("_inside") - 1).drop("_bucket", "_base", "_inside")
    return numbered, total


def shard_rows(
    docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, row_number, shard, slot) for every row of ``docs``.

    ``size`` is the UTF-8 length plus 8, ``slot`` is gapless from 0 and the shards' counts differ by
    one at most (law ``rows``). The place of a row follows from its row number alone (``shard_of``),
    and that from the ids and texts, whatever the files and their order. A null text counts as
    empty, a null id as an id of its own; repeated rows get a slot each. Texts that are equal are
    not kept together: the shuffle deals them out. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    numbered, total = number_rows(settle(slim), ["doc_id", "size", "text_crc32"])

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permute(rows.to_numpy(), total, seed))

    place = F.pandas_udf(place, "bigint")
    return numbered.withColumn("_place", place("row_number")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "row_number",
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet, one folder ``shard=N`` each, rows in slot order.

    Ids must be unique here; rows are dealt to their shard by one shuffle.
    """
    places = shard_rows(docs, shards, seed, id_col, text_col).select(
        F.col("doc_id").alias("_id"), "shard", "slot")
    placed = docs.join(places, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
