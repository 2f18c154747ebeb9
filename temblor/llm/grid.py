"""Vectors on the integer grid ``floor(256 * x)``, and sums over them that are added up by Spark."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

STEPS = 256  # grid steps in one
MERGERS = 16


def on_grid(vectors: DataFrame, vector_col: str, **kept: str) -> tuple[DataFrame, int]:
    """(rows, length): ``kept`` columns under their new names and ``x``, the grid vector as array<bigint>.

    Rows whose vector is null or holds a null or non-finite component are dropped. ``x`` is null where
    the vector has another length than most (of equally common lengths the longest counts), or a
    component that is too large for exact squares in longs (``largest``). Without rows the length is 0.
    """
    v = F.col(f"`{vector_col}`")
    # ``c - c`` is 0 for finite numbers only.
    sound = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (c - c == 0))
    rows = vectors.filter(sound).select(
        *[F.col(f"`{old}`").alias(new) for new, old in kept.items()],
        F.transform(v, lambda c: F.floor(c.cast("double") * STEPS)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    length = first["length"] if first else 0
    fits = (F.size("x") == length) & F.forall("x", lambda c: F.abs(c) <= largest(length))
    return rows.withColumn("x", F.when(fits, F.col("x"))), length


def largest(length: int) -> int:
    """Components up to this size have squared distances that fit a long, summed over a whole vector."""
    return math.isqrt((2**63 - 1) // max(length, 1)) // 2


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The vectors of an array<bigint> column without nulls, one in each row."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), length)


Batches = Iterator[pa.RecordBatch]


def add_up(frame: DataFrame, partial: Callable[[Batches], np.ndarray], exact: bool) -> list[int] | np.ndarray:
    """The element-wise sum of the arrays that ``partial`` gives for each task.

    A task sends one row. ``MERGERS`` tasks add these up, and the driver adds theirs; so it holds that
    many arrays, whatever the data. With ``exact`` the arrays hold int64, and their sum is made of
    Python integers that have no limit; otherwise they hold doubles.
    """
    kind = np.int64 if exact else np.float64

    def row(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def each(batches: Batches) -> Batches:
        total = partial(batches)
        # High and low halves, whose sums have room for as many tasks as there can be.
        yield row(np.concatenate([total >> 32, total & 0xFFFFFFFF]) if exact else total)

    def merge(batches: Batches) -> Batches:
        total = None
        for batch in batches:
            for value in batch.column("total"):
                one = np.frombuffer(value.as_buffer(), kind)
                total = one if total is None else total + one
        if total is not None:
            yield row(total)

    rows = frame.mapInArrow(each, "total binary").repartition(MERGERS).mapInArrow(merge, "total binary").collect()
    if not rows:
        return []
    total = sum(np.frombuffer(r["total"], kind) for r in rows)
    if not exact:
        return total
    high, low = np.split(total, 2)
    return [(int(h) << 32) + int(w) for h, w in zip(high, low)]
