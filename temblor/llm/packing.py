"""Hierarchical packing of token documents into windows of several lengths.

A document gives whole windows of the longest length and a rest. A rest longer than ``FLUID`` goes
whole to the shortest tier window that holds it; gaps of longer windows are filled with whole rests
of shorter tiers, best fit first. The shortest rests are fluid: they fill what gaps are left, cut
where a gap ends, and then windows of the shortest tier. So every window is full.

How many rests there are of each length fixes the plan, and there are fewer lengths than tokens in
the longest window: the driver sees these counts only. Which document takes which place follows from
its rank among the documents with a rest of equal length, which Spark works out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from temblor.llm.tokens import tokenizer
from temblor.session import new_work_folder

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 65_536
END_ID = 2
_SALTS = 256


@dataclass
class Plan:
    """Places of rests. Bins of one group hold rests of the same lengths in the same order."""

    longest: int
    fluid: int  # rests up to this length are fluid
    seg_key: np.ndarray  # length << 40 | first rank: whole rests, sorted
    seg_group: np.ndarray
    seg_offset: np.ndarray
    window: np.ndarray  # of each group, and so on
    first_sequence: np.ndarray
    gap: np.ndarray
    gap_offset: np.ndarray
    gap_start: np.ndarray  # place of the group's gaps in the fluid stream; one more at the end
    fluid_base: np.ndarray  # place of the first rest of each length in the fluid stream
    spill_sequence: int  # first window beyond the gaps
    tail: np.ndarray  # lengths of the windows after the last whole one of the shortest tier
    spill_windows: int
    token_base: np.ndarray  # tokens in sequences before each group; one more for the spill


def make_plan(counts: dict[int, int], whole_windows: int, tiers: tuple[int, ...] = TIERS) -> Plan:
    """``counts``: rests of each length, all shorter than the longest window."""
    longest, shortest = tiers[-1], tiers[0]
    for fluid in (*tiers[:-1], longest - 1):
        groups = _bins({r: n for r, n in counts.items() if r > fluid}, tiers)
        stream = sum(r * n for r, n in counts.items() if r <= fluid)
        gaps = sum(g["gap"] * g["n"] for g in groups)
        if stream >= gaps:
            break
    groups.sort(key=lambda g: -g["window"])
    sequence, tokens, place = whole_windows, whole_windows * longest, 0
    first, starts, bases, segments = [], [], [], []
    for j, g in enumerate(groups):
        first.append(sequence)
        starts.append(place)
        bases.append(tokens)
        offset = 0
        for length, rank in g["parts"]:
            segments.append((length << 40 | rank, j, offset))
            offset += length
        g["filled"] = offset
        sequence += g["n"]
        tokens += g["n"] * g["window"]
        place += g["n"] * g["gap"]
    segments.sort()
    base = np.zeros(longest + 1, np.int64)
    run = 0
    for r in range(1, fluid + 1):
        base[r] = run
        run += r * counts.get(r, 0)
    spill = stream - gaps
    tail = [2**b for b in reversed(range(shortest.bit_length())) if (spill % shortest) >> b & 1]
    column = lambda values: np.array(values, np.int64)
    return Plan(
        longest, fluid, column([s[0] for s in segments]), column([s[1] for s in segments]),
        column([s[2] for s in segments]), column([g["window"] for g in groups]), column(first),
        column([g["gap"] for g in groups]), column([g["filled"] for g in groups]),
        column([*starts, place]), base, sequence, column(tail), spill // shortest, column([*bases, tokens]))


def _bins(counts: dict[int, int], tiers: tuple[int, ...]) -> list[dict]:
    """Groups of equal bins: window, number, gap, and (length, first rank) of what they hold."""
    open_: dict[int, list[dict]] = {}
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for gap in sorted(g for g in open_ if g >= length):
            while left and open_[gap]:
                group = open_[gap].pop()
                n = min(left, group["n"])
                if n < group["n"]:
                    rest = [(r, k + n) for r, k in group["parts"]]
                    open_[gap].append(group | {"n": group["n"] - n, "parts": rest})
                filled = group | {"n": n, "gap": gap - length, "parts": [*group["parts"], (length, rank)]}
                open_.setdefault(gap - length, []).append(filled)
                left, rank = left - n, rank + n
        if left:
            window = next(t for t in tiers if t >= length)
            open_.setdefault(window - length, []).append(
                {"window": window, "n": left, "gap": window - length, "parts": [(length, rank)]})
    return [g for groups in open_.values() for g in groups]


def place_rest(plan: Plan, length: int, rank: int, shortest: int = TIERS[0]) -> list[tuple[int, int, int, int, int]]:
    """(start in the rest, length, sequence, offset, window, tokens before) of each piece of a rest."""
    if length > plan.fluid:
        k = int(np.searchsorted(plan.seg_key, length << 40 | rank, side="right")) - 1
        j, i = int(plan.seg_group[k]), rank - (int(plan.seg_key[k]) & (1 << 40) - 1)
        window = int(plan.window[j])
        return [(0, length, int(plan.first_sequence[j]) + i, int(plan.seg_offset[k]), window, int(plan.token_base[j]) + i * window)]
    pieces, done = [], 0
    at = int(plan.fluid_base[length]) + rank * length
    gaps = int(plan.gap_start[-1])
    while done < length:
        here = at + done
        if here < gaps:
            j = int(np.searchsorted(plan.gap_start, here, side="right")) - 1
            gap, window = int(plan.gap[j]), int(plan.window[j])
            i, inside = divmod(here - int(plan.gap_start[j]), gap)
            sequence, offset, room = int(plan.first_sequence[j]) + i, int(plan.gap_offset[j]) + inside, gap - inside
            before = int(plan.token_base[j]) + i * window
        else:
            i, inside = divmod(here - gaps, shortest)
            if i < plan.spill_windows:
                sequence, offset, room, window = plan.spill_sequence + i, inside, shortest - inside, shortest
                before = int(plan.token_base[-1]) + i * shortest
            else:
                ends = np.cumsum(plan.tail)
                t = int(np.searchsorted(ends, inside, side="right"))
                window = int(plan.tail[t])
                offset, room = inside - int(ends[t]) + window, int(ends[t]) - inside
                sequence = plan.spill_sequence + plan.spill_windows + t
                before = int(plan.token_base[-1]) + plan.spill_windows * shortest + int(ends[t]) - window
        n = min(room, length - done)
        pieces.append((done, n, sequence, offset, window, before))
        done += n
    return pieces


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids): 16-bit little-endian ids of the whole text and ``end_id``."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        end = np.array([end_id], np.uint16).tobytes()
        for batch in batches:
            row = 0
            for ids, bounds in words.encode(batch.column("text")):
                raw = ids.tobytes()
                found = [raw[2 * a : 2 * b] + end for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(found)), pa.array(np.diff(bounds) + 1), pa.array(found, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])
                row += len(found)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        encode, "doc_id bigint, n_tokens bigint, ids binary")


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    window, step_group.

    ``path`` is a tokenizer file that every worker can open. All windows are full; only the last few
    tokens of all go to windows of smaller powers of two. Sequences are numbered from the longest
    windows down, and each step group of consecutive sequences has ``STEP_TOKENS`` tokens.

    A null or empty text is the end id alone. Repeated rows and null ids are documents of their own.
    An empty table gives no rows.
    """
    spark, longest = docs.sparkSession, tiers[-1]
    folder = new_work_folder(spark, "tokens")
    # Written, not recomputed: row numbers must stay, and text is tokenized once.
    tokenize(docs, path, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()).write.parquet(folder)
    tokens = spark.read.parquet(folder)
    rows = tokens.select(
        "uid", F.expr(f"n_tokens div {longest}").alias("whole"), (F.col("n_tokens") % longest).cast("int").alias("rest"),
        F.pmod(F.xxhash64("uid"), F.lit(_SALTS)).cast("int").alias("salt"))

    # Ranks among rests of equal length; a common length is counted in parts.
    parts = rows.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("rest", "salt").orderBy("uid")) - 1
    ranked = rows.withColumn("inside", inside).join(parts.select("rest", "salt", "base"), ["rest", "salt"])
    # The same for whole windows.
    sums = rows.groupBy("salt").agg(F.sum("whole").alias("n")).collect()  # one row for each salt
    counts = {r["rest"]: r["n"] for r in rows.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect() if r["rest"]}
    whole_base, run = {}, 0
    for r in sorted(sums):
        whole_base[r["salt"]] = run
        run += r["n"]
    running = Window.partitionBy("salt").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.broadcast(spark.createDataFrame(sorted(whole_base.items()), "salt int, whole_start bigint"))
    long_ones = rows.filter("whole > 0").withColumn("earlier", F.coalesce(F.sum("whole").over(running), F.lit(0))).join(
        bases, "salt").select("uid", (F.col("whole_start") + F.col("earlier")).alias("first_whole"))
    plan = make_plan(counts, run, tiers)
    shared = spark.sparkContext.broadcast(plan)  # fewer segments than lengths times lengths
    places = ranked.select("uid", (F.col("base") + F.col("inside")).alias("rank")).join(long_ones, "uid", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, n, raw, rank, first in zip(
                batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids"),
                batch.column("rank").to_pylist(), batch.column("first_whole").to_pylist(),
            ):
                ids = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4")
                whole, rest = divmod(n, longest)
                pieces = [(k * longest, longest, first + k, 0, longest, (first + k) * longest) for k in range(whole)]
                if rest:
                    pieces += [(whole * longest + s, *more) for s, *more in place_rest(plan, rest, rank, tiers[0])]
                for start, length, sequence, offset, window, tokens_before in pieces:
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    row = (doc_id, start, length, crc, n, sequence, offset, window, tokens_before // STEP_TOKENS)
                    for values, value in zip(out, row):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()) for values in out], names=names)

    return tokens.join(places, "uid").select("doc_id", "n_tokens", "ids", "rank", "first_whole").mapInArrow(
        cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, window bigint, step_group bigint")
