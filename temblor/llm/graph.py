"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from temblor.session import settle  # noqa: F401

BLOCK = 500_000  # edges that one task contracts: two longs each


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one block as stars: each id linked to the smallest that it reaches inside the block."""
    parts = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        # Larger roots go to smaller ones, then every id to its root's root until nothing moves.
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id with a link, and the smallest id that it reaches.

    Edges between numbers are first contracted in blocks of ``BLOCK``, each inside a task, to at most
    one edge for each id of the block. One block is the whole graph and needs no more. Otherwise, and for ids of
    other types, each round halves the distances to the smallest id at least; a star of any size is
    one round. Minima are combined before the shuffle, and a node with very many links is joined by a
    plain equi-join that adaptive execution splits. Edges of an id with itself and repeats are
    harmless; an empty table gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v")
    if pairs.schema["u"].dataType.simpleString() == "bigint":
        pairs = settle(pairs)
        blocks = pairs.count() // BLOCK + 1
        current = pairs.repartition(blocks).mapInArrow(_contract, "u bigint, v bigint")
        if blocks == 1:
            return _ended(settle(current))
    else:
        current = pairs.distinct()
    current = settle(current)
    before = None
    while True:
        # Large star: what is larger than a node is linked to the node's smallest neighbour.
        both = current.select("u", "v").union(current.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of a node, and the node, go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()
        current = settle(small)
        mark = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    return _ended(current)


def _ended(current: DataFrame) -> DataFrame:
    """Ids and roots from stars."""
    nodes = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
