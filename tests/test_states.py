"""Processors with a state of their own, against plain Python."""

import random
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import hours, utc
from temblor.plans import store as stores
from temblor.plans.states import active_days, largest, merge_states, state_results, summarize_states
from temblor.plans.store import Store, read_store, read_store_states, take_in

START = utc(2024, 5, 1)
TOP = largest("top", {"flynn_region": lambda: F.col("flynn_region"), "deep": lambda: F.col("depth")}, 2)
DAYS = active_days("days", {"magtype": lambda: F.col("magtype")})
BOTH = (TOP, DAYS)


def rows_of(rng, n, name=""):
    return [{
        "unid": rng.choice([None, f"{name}{i}", f"{name}{i}"]), "mag": rng.choice([None, float("nan"), 1.0, 2.0, rng.randint(0, 60) / 10]),
        "time": rng.choice([None, START + timedelta(days=rng.randint(0, 12) - 6, seconds=rng.randint(0, 86_399))]),
        "flynn_region": rng.choice([None, "A", "B"]), "depth": rng.choice([None, 0.0, -0.0, float("nan"), 5.0]),
        "magtype": rng.choice([None, "", "ml"]), "lastupdate": START} for i in range(n)]


def named(value):
    return "nan" if value != value else None if value is None else value + 0 if isinstance(value, float) else value


def plain(rows):
    """What both processors should say, from rows as tuples of a collected frame."""
    top, days = defaultdict(list), defaultdict(set)
    for r in rows:
        top[r["flynn_region"], named(r["depth"])] += [(r["mag"], r["unid"])] if r["mag"] is not None and r["mag"] == r["mag"] else []
        days[r["magtype"]] |= set() if r["time"] is None else {r["time"].date()}
    best = {k: sorted(v, key=lambda p: (-p[0], p[1] is None, p[1] or ""))[:2] for k, v in top.items()}
    runs = {}
    for k, found in days.items():
        longest = 0
        for day in found:
            length = 1
            while day + timedelta(days=length) in found:
                length += 1
            longest = max(longest, length)
        runs[k] = (len(found), longest)
    return best, runs


def said(states):
    best = {(r["flynn_region"], named(r["deep"])): [tuple(e) for e in r["result"]] for r in state_results(states, TOP).collect()}
    return best, {r["magtype"]: tuple(r["result"]) for r in state_results(states, DAYS).collect()}


@pytest.mark.parametrize("held", [1, 3, 10_000])
def test_states_equal_plain_python(make, held):
    events = make(*rows_of(random.Random(held), 120)).repartition(5)
    states = summarize_states(events, BOTH, held=held)
    assert states.count() == states.select("processor", "flynn_region", "deep", "magtype").distinct().count()
    assert said(states) == plain(events.collect())


def test_states_add_up(make):
    rng = random.Random(5)
    parts = [make(*rows_of(rng, 40, f"p{k}-")) for k in range(3)]
    partial = [summarize_states(p, BOTH) for p in parts]
    merged = merge_states(partial[2].unionByName(partial[0]).unionByName(partial[1]), BOTH)
    assert said(merged) == plain([r for p in parts for r in p.collect()])


def test_no_events_and_shared_names(make):
    assert summarize_states(make({}).limit(0), BOTH).count() == 0
    with pytest.raises(ValueError):
        summarize_states(make({}), (TOP, TOP))


def test_rows_are_folded_before_the_shuffle(make):
    states = summarize_states(make({}), BOTH)
    plan = states._jdf.queryExecution().executedPlan().toString()
    before, after = plan[plan.index("Exchange"):], plan[: plan.index("Exchange")]
    assert plan.count("Exchange") == 1 and "MapInArrow" in before and "MapInArrow" in after


def test_a_store_keeps_states_through_every_change(spark, make, tmp_path):
    rng, store = random.Random(11), Store(str(tmp_path), states=BOTH)

    def consistent():
        assert said(read_store_states(spark, store)) == plain(read_store(spark, store).collect())

    assert read_store_states(spark, store).count() == 0
    take_in(spark, store, make(*rows_of(rng, 40)), "a", "latest")
    newer = [r | {"lastupdate": START + hours(1)} for r in rows_of(rng, 25)]
    take_in(spark, store, make(*newer), "b", "latest")
    consistent()
    stores.merge_loads(spark, store, "c", most=1)
    consistent()
    stores.retain(spark, store, START, stores.RetentionConfig(auto_cleanup=True, max_events=20))
    consistent()
    stores.rebuild(spark, store)
    consistent()
