"""Product codes of vectors, with memoised grid cells for the nearest codebook entry.

A vector is cut into parts and each part gets the index of the nearest of its position's entries.
The space of a part is divided into coarse cells, boxes of equal width. For a box the distance to
each entry has a least and a greatest value; an entry whose least is above the smallest greatest
cannot be the nearest of any point in the box. What is left, mostly a few of all entries, is kept for
the cell, and only these are worked out exactly for the parts that fall into it. All distances are
integers, so ties are exact and go to the lower index.

A round of learning sends one row with the sums for all codebooks from each task; the codebooks,
whose size does not depend on the data, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from temblor.llm.graph import settle
from temblor.llm.grid import Batches, add_up, matrix, on_grid

PARTS, ENTRIES, ROUNDS = 16, 64, 2
CELLS = 200_000  # cells that a task remembers for each part; further ones are worked out again
SMALL_LABELS = 100_000  # so many label sums are sent to all tasks at most


def cuts(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """First and end of each part; equal ones where ``parts`` divides ``length``."""
    edges = [k * length // parts for k in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:]))


@dataclass
class Cells:
    """The nearest of ``entries`` (rows) for points, found through the points' cells."""

    entries: np.ndarray
    limit: int = CELLS
    known: dict[bytes, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        gaps = ((self.entries[:, None, :] - self.entries[None, :, :]).astype(float) ** 2).sum(2)
        apart = gaps[gaps > 0]
        # A box about as long as two entries are apart.
        spacing = math.sqrt(np.median(np.where(gaps > 0, gaps, np.inf).min(1))) if len(apart) else 1.0
        width = spacing / math.sqrt(max(self.entries.shape[1], 1)) if math.isfinite(spacing) else 1.0
        self.shift = max(0, math.ceil(math.log2(max(width, 1.0))))

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries, ascending, that may be nearest somewhere in each cell."""
        found = [self.known.get(c.tobytes()) for c in cells]
        missing = [i for i, f in enumerate(found) if f is None]
        # In blocks, as each takes all entries.
        for at in range(0, len(missing), 4_096):
            block = missing[at : at + 4_096]
            low = (cells[block] << self.shift)[:, None, :]
            high = low + ((1 << self.shift) - 1)
            # Distances to the two faces; a point between them is at 0 from the box.
            below, above = low - self.entries, self.entries - high
            least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
            most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
            # An entry that can only tie with the best may have the lower index.
            near = least <= most.min(1, keepdims=True)
            for i, row in zip(block, near):
                found[i] = np.flatnonzero(row)
                if len(self.known) < self.limit:
                    self.known[cells[i].tobytes()] = found[i]
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, the lower index on ties."""
        if not len(points) or not points.shape[1]:
            return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        cells = points >> self.shift
        unique, inverse = _distinct_rows(cells)
        lists = self.candidates(unique)
        sizes = np.array([len(c) for c in lists])
        firsts = np.cumsum(sizes) - sizes
        # One row for each point and candidate of its cell.
        mine = sizes[inverse]
        starts = np.cumsum(mine) - mine
        point = np.repeat(np.arange(len(points)), mine)
        entry = np.concatenate(lists)[np.repeat(firsts[inverse] - starts, mine) + np.arange(len(point))]
        distance = ((points[point] - self.entries[entry]) ** 2).sum(1)
        best = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == best[point])
        first = hits[np.searchsorted(point[hits], np.arange(len(points)))]
        return entry[first], best


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and for each row the place of its like among them."""
    low = rows.min(0)
    spans = [int(s) + 1 for s in rows.max(0) - low]
    if math.prod(spans) >= 2**62:
        unique, inverse = np.unique(rows, axis=0, return_inverse=True)
        return unique, inverse.ravel()
    key = np.zeros(len(rows), np.int64)
    for k, span in enumerate(spans):
        key = key * span + (rows[:, k] - low[k])
    _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
    return rows[index], inverse


def _slices(batches: Batches, rows: int = 8_192):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _adder(books: list[np.ndarray], length: int):
    """Counts and sums of the parts nearest to each entry, of a whole task: entry by entry, with the
    count in front of the components."""

    def add(batches: Batches) -> np.ndarray:
        cells = [Cells(b) for b in books]
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in _slices(batches):
            x = matrix(batch.column("x"), length)
            for (a, b), cell, total in zip(cuts(length, len(books)), cells, sums):
                entry, _ = cell.nearest(x[:, a:b])
                np.add.at(total, entry, np.hstack([np.ones((len(x), 1), np.int64), x[:, a:b]]))
        return np.concatenate([s.ravel() for s in sums])

    return add


def learn_codebooks(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One array of entries for each part from (id, x): it starts as that part of the first ``entries``
    rows by id (ties by vector, null ids last); each round moves every entry to the floor of the mean
    of the parts nearest to it. Fewer rows give fewer entries, no rows none."""
    rows = rows.filter("x is not null")
    first = rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()
    seeds = np.array([r["x"] for r in first], np.int64).reshape(len(first), length)
    books = [seeds[:, a:b].copy() for a, b in cuts(length, parts)]
    for _ in range(rounds if first else 0):
        totals = add_up(rows.select("x"), _adder(books, length), exact=True)
        at = 0
        for book in books:
            width = book.shape[1] + 1
            for e in range(len(book)):
                n = totals[at]
                if n:
                    book[e] = [totals[at + 1 + k] // n for k in range(width - 1)]
                at += width
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def _encoder(books: list[np.ndarray], length: int):
    def encode(batches: Batches) -> Batches:
        cells = [Cells(b) for b in books]
        for batch in _slices(batches):
            there = np.asarray(batch.column("x").is_valid())
            x = matrix(batch.column("x").drop_null(), length)
            codes = np.zeros((len(x), len(books)), np.uint8)
            error = np.zeros(len(x), np.int64)
            for k, ((a, b), cell) in enumerate(zip(cuts(length, len(books)), cells)):
                entry, distance = cell.nearest(x[:, a:b])
                codes[:, k] = entry
                error += distance
            hexed = codes.tobytes().hex()
            width = 2 * len(books)
            texts, errors = [None] * len(there), np.zeros(len(there), np.int64)
            for i, row in enumerate(np.flatnonzero(there)):
                texts[row] = hexed[i * width : (i + 1) * width]
            errors[there] = error
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(errors, mask=~there)],
                names=["id", "label", "code", "error"])

    return encode


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every sound row of ``vectors``.

    Components are grid steps (``floor(256 * x)``). ``code`` holds two hexadecimal digits for each
    part, ``error`` the squared distances summed over the parts, ``label_error`` the errors summed over
    rows of equal label, nulls together. At most 256 entries.

    Rows whose vector is null or holds null or non-finite components are dropped. A vector of another
    length than most, or with a component beyond what longs can square exactly, is no part of the
    codebooks and has null code and error. Vectors whose length ``parts`` does not divide are cut as
    evenly as can be. Repeated rows and ids are rows of their own; a row without id is coded, and comes
    last in the choice of first entries. Fewer rows than entries give codebooks of that size. An empty
    table gives no rows. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("two hexadecimal digits tell 256 entries apart")
    rows, length = on_grid(vectors, vector_col, id=id_col, label=label_col)
    books = learn_codebooks(rows, length, parts, entries, rounds)
    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])
    coded = settle(rows.mapInArrow(_encoder(books, length), schema))
    sums = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    if sums.count() <= SMALL_LABELS:
        sums = F.broadcast(sums)
    coded, sums = coded.alias("c"), sums.alias("s")
    return coded.join(sums, F.col("c.label").eqNullSafe(F.col("s.label")), "left").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
