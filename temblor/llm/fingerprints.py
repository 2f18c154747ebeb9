"""Threshold-scaled sketches: every shingle hash below a fixed fraction is kept."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from temblor.llm.words import Words, text_slices

SHINGLE = 5
FRACTION_BITS = 2  # one hash in four is kept
_KEPT = np.uint64(2 ** (64 - FRACTION_BITS))
_DROP = np.uint64(22)  # 40 bits of a kept hash are written
# Texts with fewer kept hashes are compared by their windows of bytes as well.
FEW = 32
WINDOW = 16  # a power of two
_ALL = np.uint64(2**40)
_BLOCK = 1 << 14  # bytes looked at together; their hashes fit a core's cache
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93


def _smallest_windows(text: bytes) -> np.ndarray:
    """The ``FEW`` smallest hashes, of 40 bits, of windows of bytes, A-Z lower-cased.

    There is a window for each byte: it and up to ``WINDOW`` - 1 bytes before it. So a text of few
    bytes has windows too, and a common beginning of two texts is seen.
    """
    raw, kept = _LOWER[np.frombuffer(text, np.uint8)], np.zeros(0, np.uint64)
    for a in range(0, len(raw), _BLOCK):
        begin = max(a - WINDOW + 1, 0)
        hashes, step, factor = _BYTE[raw[begin : a + _BLOCK]], 1, _BASE
        while step < WINDOW:
            wider = hashes.copy()
            wider[step:] += hashes[:-step] * np.uint64(factor)
            hashes, step, factor = wider, step * 2, factor * factor % 2**64
        hashes = _mixed(hashes[a - begin :]) >> np.uint64(24)
        if len(kept) == FEW:
            hashes = hashes[hashes < kept[-1]]
        kept = np.union1d(kept, _distinct_smallest(hashes))[:FEW]
    return kept


def _distinct_smallest(hashes: np.ndarray) -> np.ndarray:
    """The ``FEW`` smallest different hashes and perhaps more; all are sorted only if many are equal."""
    if len(hashes) > 4 * FEW:
        some = np.unique(np.partition(hashes, 2 * FEW)[: 2 * FEW + 1])
        if len(some) >= FEW:
            return some
    return np.unique(hashes)


class Sketch:
    """The kept hashes of a text, a digest of the text itself and its smallest window hashes.

    ``merge`` is the union of the hashes: the sketch of two texts read as one collection.
    """

    __slots__ = ("mark", "hashes", "windows")

    def __init__(self, mark: str, hashes: np.ndarray, windows: np.ndarray | None = None):
        self.mark, self.hashes = mark, hashes
        self.windows = np.zeros(0, np.uint64) if windows is None else windows

    def written(self) -> str:
        parts = [h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:] for h in (self.hashes, self.windows)]
        return ":".join([self.mark, *[base64.b64encode(raw.tobytes()).decode() for raw in parts]])

    @staticmethod
    def read(text: str) -> Sketch:
        mark, *bodies = text.split(":")
        found = []
        for body in bodies:
            raw = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, 3:] = raw
            found.append(wide.view(">u8").astype(np.uint64).ravel())
        return Sketch(mark, *found)

    def merge(self, other: Sketch) -> Sketch:
        return Sketch("", np.union1d(self.hashes, other.hashes), np.union1d(self.windows, other.windows)[:FEW])

    def containment(self, other: Sketch) -> float:
        """Share of this sketch's hashes that the other has as well."""
        if not len(self.hashes):
            return float(self.mark == other.mark)
        return len(np.intersect1d(self.hashes, other.hashes, assume_unique=True)) / len(self.hashes)

    def _pooled(self, other: Sketch) -> float:
        """The share over hashes and windows together; texts of few different words have few of either."""
        # With fewer than FEW all windows are known, else those up to the last.
        known = [s.windows[-1] if len(s.windows) == FEW else _ALL for s in (self, other)]
        mine, theirs = (s.windows[s.windows <= min(known)] for s in (self, other))
        looked_at = min(len(mine), len(theirs)) + len(self.hashes)
        found = sum(len(np.intersect1d(a, b, assume_unique=True)) for a, b in ((mine, theirs), (self.hashes, other.hashes)))
        return found / looked_at if looked_at else 0.0

    def likeness(self, other: Sketch) -> float:
        """Share of the smaller sketch that the larger contains: 1 for equal texts and for a part
        of a longer text. If the smaller has fewer than ``FEW`` hashes, too few for a share, it is
        estimated from the windows as well; an empty text is alike only to an empty one."""
        if self.mark and self.mark == other.mark:
            return 1.0
        small, large = sorted((self, other), key=lambda s: len(s.hashes))
        return small.containment(large) if len(small.hashes) >= FEW else small._pooled(large)


def sketches(texts: list[str]) -> list[Sketch]:
    """Sketches of texts. Shingles are five words, A-Z lower-cased, or a shorter text as a whole."""
    out = []
    for row, raw, offsets in text_slices(pa.array(texts, pa.large_string())):
        hashes, bounds = Words(raw, offsets).shingles(SHINGLE)
        low = hashes < _KEPT
        kept = hashes[low] >> _DROP
        edges = np.concatenate([[0], np.cumsum(low)])[bounds]
        for i in range(len(offsets) - 1):
            text = raw[offsets[i] : offsets[i + 1]]
            mark = hashlib.blake2b(text, digest_size=8).hexdigest()
            out.append(Sketch(mark, np.unique(kept[edges[i] : edges[i + 1]]), _smallest_windows(text)))
    return out


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``; one pass without a shuffle. A null text is empty."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.append_column("fingerprint", pa.array([s.written() for s in sketches(texts)]))

    kept = docs.drop("fingerprint")
    schema = T.StructType([*kept.schema.fields, T.StructField("fingerprint", T.StringType())])
    return kept.mapInArrow(add, schema)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by bucket and id; the row after the last of a bucket is a guest."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            # Slices keep few texts as Python strings at a time.
            part = batch.slice(start, 256)
            start += part.num_rows
            rows = list(zip(
                part.column("bucket").to_pylist(), part.column("guest").to_pylist(),
                part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]))
            own = sketches([r[3] for r in rows])
            done, edited = [], []
            for row, sketch in zip(rows, own):
                if held and not held[0][1]:
                    (_, _, doc_id, text), mine = held
                    half = len(text) // 2
                    new = text[: len(text) - half] + row[3][:half]
                    done.append((doc_id, len(text), mine, sketch))
                    edited.append(new)
                held = (row, sketch)
            changed = sketches(edited)
            columns = [
                [d[0] for d in done], [d[1] for d in done],
                [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                [d[2].written() for d in done], [c.written() for c in changed],
                [d[2].likeness(c) for d, c in zip(done, changed)],
                [d[2].likeness(d[3]) for d in done],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 256) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text of a document has its last ``n_chars // 2`` code points replaced by the first
    as many of the next document by id (after the last id, of the first). Ids are cut into
    ``buckets`` ranges of about as many rows; the first row of a range is also sent, as a guest, to
    the range before. So texts are shuffled once, and a task holds two of them at a time.

    A null text is empty. Rows of equal id follow each other in the order of their texts; null ids
    come first. One row is its own next document; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx(
        "doc_id", [i / buckets for i in range(1, buckets)], 100 * buckets).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))  # fewer than ``buckets`` numbers
    edges = np.array(cuts, np.int64)

    def bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            found = np.searchsorted(edges, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
            yield batch.append_column("bucket", pa.array(found, pa.int32()))

    bucketed = rows.mapInArrow(bucket_of, "doc_id bigint, text string, bucket int")
    # The first row of each range: the smallest id and, of equal ids, the smallest text. Only these
    # few texts are looked up again.
    firsts = rows.select("doc_id").mapInArrow(bucket_of, "doc_id bigint, bucket int").groupBy("bucket").agg(
        F.min(F.struct("doc_id")).alias("m")).select("bucket", "m.doc_id").collect()  # ``buckets`` rows
    firsts = sorted((r["bucket"], r["doc_id"]) for r in firsts)
    if not firsts:
        return rows.mapInArrow(_compare_nothing, _COMPARED)
    order = [b for b, _ in firsts]
    before = {b: order[i - 1] for i, b in enumerate(order)}
    spark = docs.sparkSession
    wanted = spark.createDataFrame(
        [(i, before[b], i is None) for b, i in firsts], "first_id bigint, to_bucket int, is_null boolean")
    wanted = F.broadcast(wanted)
    guests = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("to_bucket", "doc_id").agg(
        F.min("text").alias("text")).select("doc_id", "text", F.col("to_bucket").alias("bucket"), F.lit(True).alias("guest"))
    everything = bucketed.withColumn("guest", F.lit(False)).unionByName(guests)
    return everything.repartition(max(buckets // 2, 1), "bucket").sortWithinPartitions(
        "bucket", "guest", "doc_id", "text").select("bucket", "guest", "doc_id", "text").mapInArrow(_compare, _COMPARED)


_COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double")


def _compare_nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return iter(())
