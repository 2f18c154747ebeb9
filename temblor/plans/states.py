"""Processors with a state of their own, for results that no sum, minimum or maximum can express.

A state is made from nothing, takes in columns of events and is merged with another one. As the
summary's measures, states of parts, loads and micro-batches add up: tasks fold their own events
first, and one small row for each key and task is shuffled. Batch, stream and store share the code.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Keys whose states a task holds at a time; with more, it hands out what it has and starts anew.
HELD_KEYS = 10_000


@dataclass(frozen=True)
class StateProcessor:
    """``add(state, columns)`` takes Arrow arrays by the names of ``inputs``, all of one key.

    ``merge(add(a, x), b)`` must equal ``merge(a, add(b, x))``, and ``zero()`` must change nothing.
    ``finish`` makes a value of the Spark type ``result``. The functions travel to the workers by
    value if they are nested or lambdas; others must be importable there.
    """

    name: str
    keys: Mapping[str, Callable[[], Column]]
    inputs: Mapping[str, Callable[[], Column]]
    zero: Callable[[], Any]
    add: Callable[[Any, dict[str, pa.Array]], Any]
    merge: Callable[[Any, Any], Any]
    dump: Callable[[Any], bytes]
    load: Callable[[bytes], Any]
    finish: Callable[[Any], Any]
    result: str


def state_keys(processors: tuple[StateProcessor, ...]) -> list[str]:
    return [key for p in processors for key in p.keys]


def _normal(column: Column, kind: T.DataType) -> Column:
    """Minus zero is zero, as in Spark's own grouping."""
    return column + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else column


def summarize_states(
    events: DataFrame, processors: tuple[StateProcessor, ...], by: tuple[str, ...] = (), held: int = HELD_KEYS,
) -> DataFrame:
    """(processor, keys..., state, by...), merged: one row for each key. Keys of other processors are null.

    One scan serves all processors. A null key is a key like others; no events give no rows.
    """
    keys = state_keys(processors)
    names = [p.name for p in processors]
    if len(set(keys)) != len(keys) or len(set(names)) != len(names):
        raise ValueError("processors must not share a name or a key column")
    keyed = events.select(
        *[expr().alias(key) for p in processors for key, expr in p.keys.items()],
        *[expr().alias(f"_{p.name}_{name}") for p in processors for name, expr in p.inputs.items()],
        *by,
    )
    types = {f.name: f.dataType for f in keyed.schema}
    keyed = keyed.withColumns({key: _normal(F.col(key), types[key]) for key in keys})
    schema = T.StructType([
        T.StructField("processor", T.StringType()), *[T.StructField(k, types[k]) for k in keys],
        T.StructField("state", T.BinaryType()), *[T.StructField(c, types[c]) for c in by]])
    # Plain functions and names only, so that workers need nothing of this package.
    plan = [(p.name, [*by, *p.keys], {n: f"_{p.name}_{n}" for n in p.inputs}, p.zero, p.add, p.dump) for p in processors]
    columns, most = schema.fieldNames(), held

    def codes_of(column: pa.Array) -> tuple[np.ndarray, int]:
        found = column.dictionary_encode(null_encoding="encode")
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(found.dictionary), 1)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        kinds: dict[str, pa.DataType] = {}

        def rows() -> pa.RecordBatch:
            out: dict[str, list] = {c: [] for c in columns}
            for (which, *values), state in states.items():
                name, own, _, _, _, dump = plan[which]
                known = dict(zip(own, values)) | {"processor": name, "state": dump(state)}
                for c in columns:
                    # A text stands for NaN, which equals nothing, among the keys held.
                    value = known.get(c)
                    out[c].append(float("nan") if value == ("nan",) else value)
            fixed = {"processor": pa.string(), "state": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(out[c], (fixed | kinds)[c]) for c in columns], names=columns)

        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in columns if c in batch.schema.names}
            if not batch.num_rows:
                continue
            for which, (_, own, inputs, zero, add, _) in enumerate(plan):
                place = np.zeros(batch.num_rows, np.int64)
                for c in own:
                    codes, n = codes_of(batch.column(c))
                    # Numbers of the groups so far, so that the product stays below rows squared.
                    place = np.unique(place * n + codes, return_inverse=True)[1].astype(np.int64)
                order = np.argsort(place, kind="stable")
                edges = np.flatnonzero(np.diff(place[order])) + 1
                starts, ends = np.append(0, edges), np.append(edges, len(order))
                heads = [batch.column(c).take(pa.array(order[starts])).to_pylist() for c in own]
                sorted_inputs = {n: batch.column(c).take(pa.array(order)) for n, c in inputs.items()}
                for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                    values = (("nan",) if isinstance(h[k], float) and h[k] != h[k] else h[k] for h in heads)
                    key = (which, *values)
                    state = states.get(key)
                    states[key] = add(zero() if state is None else state, {n: c.slice(a, b - a) for n, c in sorted_inputs.items()})
                    if len(states) >= most:
                        yield rows()
                        states.clear()
        if states:
            yield rows()

    return merge_states(keyed.mapInArrow(fold, schema), processors, by)


def merge_states(partials: DataFrame, processors: tuple[StateProcessor, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key of any number of partial states. A task holds two states at a time."""
    keys = state_keys(processors)
    shaped = partials.select("processor", *keys, "state", *by)
    whole = ["processor", *keys, *by]
    plan = {p.name: (p.merge, p.dump, p.load) for p in processors}
    columns = shaped.columns

    def same(a: tuple, b: tuple) -> bool:
        return all(x == y or (x != x and y != y) for x, y in zip(a, b))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, state as bytes, state
        for batch in batches:
            done = []
            texts = batch.column("state").to_pylist()
            for key, text in zip(zip(*[batch.column(c).to_pylist() for c in whole]), texts):
                merge, dump, load = plan[key[0]]
                if held is not None and same(held[0], key):
                    mine = load(held[1]) if held[2] is None else held[2]
                    held = (key, None, merge(mine, load(text)))
                    continue
                if held is not None:
                    done.append(held)
                held = (key, text, None)
            schema = batch.schema
            if done:
                yield written(done, schema)
        if held is not None:
            yield written([held], schema)

    def written(done: list, schema: pa.Schema) -> pa.RecordBatch:
        found = {c: [d[0][i] for d in done] for i, c in enumerate(whole)}
        found["state"] = [d[1] if d[2] is None else plan[d[0][0]][1](d[2]) for d in done]
        return pa.RecordBatch.from_arrays([pa.array(found[c], schema.field(c).type) for c in columns], names=columns)

    # Sorted runs instead of collected groups: one key may have a state from every task.
    placed = shaped.repartition(*whole).sortWithinPartitions(*whole)
    return placed.mapInArrow(runs, shaped.schema)


def state_results(states: DataFrame, processor: StateProcessor) -> DataFrame:
    """(keys..., result) of one processor, from merged states."""
    keys = list(processor.keys)
    own = states.filter(F.col("processor") == processor.name).select(*keys, "state")
    load, finish = processor.load, processor.finish
    # Once for each key; so marked, the optimizer does not copy it into filters on its result.
    finished = F.udf(lambda text: finish(load(text)), processor.result).asNondeterministic()
    return own.select(*keys, finished("state").alias("result"))


def largest(name: str, keys: Mapping[str, Callable[[], Column]], count: int) -> StateProcessor:
    """The ``count`` largest magnitudes of a key with their ids; of equal ones, the smaller ids.

    Events without a magnitude, or with NaN, are left out; a missing id comes after all others.
    """
    def rank(pair: tuple) -> tuple:
        return (-pair[0], pair[1] is None, pair[1] or "")

    def top(pairs: list) -> list:
        return sorted(pairs, key=rank)[:count]

    def add(state: list, columns: dict[str, pa.Array]) -> list:
        table = pa.table([columns["mag"], columns["unid"]], names=["mag", "unid"])
        table = table.filter(pc.invert(pc.is_null(table["mag"], nan_is_null=True)))
        # Beyond the largest, only their ties matter: those are cut by id.
        order = pc.sort_indices(table, sort_keys=[("mag", "descending"), ("unid", "ascending")])
        first = table.take(order[:count])
        return top(state + list(zip(first["mag"].to_pylist(), first["unid"].to_pylist())))

    return StateProcessor(
        name, keys, {"mag": lambda: F.col("mag").cast("double"), "unid": lambda: F.col("unid")}, list, add, lambda a, b: top(a + b),
        lambda state: json.dumps(state).encode(), lambda text: [tuple(pair) for pair in json.loads(text)],
        lambda state: state, "array<struct<mag: double, unid: string>>")


def active_days(name: str, keys: Mapping[str, Callable[[], Column]]) -> StateProcessor:
    """(days, longest): UTC days with events of a key, and the most of them in a row.

    The state is the set of days, which grows with the length of history, not with the events.
    """
    def days_of(text: bytes) -> np.ndarray:
        return np.frombuffer(text, "<i4")

    def add(state: np.ndarray, columns: dict[str, pa.Array]) -> np.ndarray:
        found = columns["day"].drop_null().to_numpy(zero_copy_only=False).astype(np.int32)
        return np.union1d(state, found)

    def finish(state: np.ndarray) -> tuple[int, int]:
        edges = np.flatnonzero(np.diff(state) != 1) + 1
        runs = np.diff(np.concatenate([[0], edges, [len(state)]]))
        return len(state), int(runs.max())

    return StateProcessor(
        name, keys, {"day": lambda: F.floor(F.unix_micros("time") / F.lit(86_400_000_000)).cast("int")},
        lambda: np.zeros(0, np.int32), add, lambda a, b: np.union1d(a, b), lambda state: state.astype("<i4").tobytes(), days_of,
        finish, "struct<days: bigint, longest: bigint>")
