"""The store against a plain model, load by load; what a change reads and leaves alone."""

import random
import re
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import hours, tuples, utc
from temblor.operators.retention import RetentionConfig, apply_retention
from temblor.plans import store as stores
from temblor.plans import summary as results
from temblor.plans import upkeep
from temblor.plans.processors import (
    MAGNITUDE, MEASURES, QUANTILES, WHOLE, Measure, Processor, merge_summaries, summarize,
)
from temblor.plans.store import Store, read_store, read_store_summary, take_in
from temblor.schema import EVENT_COLUMNS

START = utc(2024, 5, 1)


def plain(frame):
    return sorted(map(str, tuples(frame.select(*EVENT_COLUMNS))))


def consistent(spark, store):
    """The summary says what the events say."""
    def rounded(frame):
        return sorted(str([f"{v:.10g}" if isinstance(v, float) else v for v in row]) for row in tuples(frame))

    expected = merge_summaries(summarize(read_store(spark, store), store.processors, store.measures), store.processors, store.measures)
    assert rounded(read_store_summary(spark, store)) == rounded(expected)


def batch_of(rng, n, ids):
    return [{
        "unid": rng.choice([None] + ids * 3) if ids else None, "mag": rng.choice([None, rng.randint(0, 60) / 10]),
        "time": rng.choice([None] + [START + timedelta(days=d, seconds=rng.randint(0, 86_399)) for d in range(4)]),
        "lastupdate": rng.choice([None] + [START + hours(h) for h in range(5)]), "flynn_region": rng.choice([None, "A", "B"]),
        "depth": float(i)} for i, _ in enumerate(range(n))]


@pytest.mark.parametrize("rule", ["first", "latest", "all"])
def test_loads_equal_a_plain_model(spark, make, tmp_path, rule):
    rng = random.Random(rule)
    store, known, nameless = Store(str(tmp_path)), {}, []
    for k in range(4):
        # Ids once in a batch, so that the model needs no rule for the order inside it.
        rows = batch_of(rng, 25, [])
        for row, unid in zip(rows, rng.sample([f"e{i}" for i in range(40)], 20)):
            row["unid"] = unid
        frame = make(*rows)
        for _ in range(2 if k == 3 else 1):
            take_in(spark, store, frame, f"load-{k}", rule)
        for row in frame.collect():
            old = known.get(row["unid"])
            if row["unid"] is None or rule == "all":
                nameless.append(row)
            elif old is None or (rule == "latest" and (old["lastupdate"] is None or (
                    row["lastupdate"] is not None and row["lastupdate"] >= old["lastupdate"]))):
                known[row["unid"]] = row
        assert plain(read_store(spark, store)) == sorted(str(tuple(r)) for r in [*known.values(), *nameless])
    consistent(spark, store)
    before = plain(read_store(spark, store))
    stores.merge_loads(spark, store, "merged", most=2)
    assert plain(read_store(spark, store)) == before
    consistent(spark, store)
    stores.rebuild(spark, store)
    consistent(spark, store)


def test_order_of_arrival_inside_a_load(spark, make, tmp_path):
    pair = make({"unid": "a", "mag": 1.0}, {"unid": "a", "mag": 2.0}).withColumn("place", F.col("mag").cast("int"))
    for rule, mag in (("first", 1.0), ("latest", 2.0)):
        store = Store(str(tmp_path / rule))
        take_in(spark, store, pair, "one", rule, ("place",))
        assert [r["mag"] for r in read_store(spark, store).collect()] == [mag]


def days(make, n=6, each=20):
    return make(*[{"unid": f"d{d}-{i}", "time": START + timedelta(days=d, minutes=i), "lastupdate": START, "mag": i / 10}
                  for d in range(n) for i in range(each)])


def files(root, but=()):
    return sorted(str(p) for p in Path(root).rglob("*.parquet") if not any(b in str(p) for b in but))


def test_an_update_opens_only_the_cells_it_touches(spark, make, tmp_path):
    store = Store(str(tmp_path / "s"))
    take_in(spark, store, days(make), "a", "latest")
    before = files(store.events), files(store.summary)
    # No other date can be read any more.
    hidden = {}
    for folder in (store.events, store.summary):
        for path in files(folder, ["event_date=2024-05-03"]):
            hidden[path] = Path(path).read_bytes()
            Path(path).write_bytes(b"not a table")
            crc = Path(path).with_name(f".{Path(path).name}.crc")
            if crc.exists():
                crc.unlink()
    update = make({"unid": "d2-7", "time": START + timedelta(days=9), "lastupdate": START + hours(1), "mag": 5.0})
    take_in(spark, store, update, "b", "latest")
    for path, data in hidden.items():
        assert Path(path).read_bytes() == b"not a table"
        Path(path).write_bytes(data)
    after = files(store.events), files(store.summary)
    for old, new in zip(before, after):
        assert [p for p in old if "05-03" not in p] == [p for p in new if "05-03" not in p and "load=b" not in p]
    assert read_store(spark, store).filter("unid = 'd2-7'").select("mag").first()["mag"] == 5.0
    assert read_store(spark, store).count() == 120
    consistent(spark, store)


def test_a_small_load_opens_few_parts_of_the_index(spark, make, tmp_path):
    store = Store(str(tmp_path))
    take_in(spark, store, days(make), "a")
    bucket = days(make).filter("unid = 'd1-3'").select(stores._bucket()).first()["bucket"]
    for path in files(store.ids, [f"bucket={bucket}/"]):
        Path(path).write_bytes(b"not a table")
        Path(path).with_name(f".{Path(path).name}.crc").unlink(missing_ok=True)
    take_in(spark, store, make({"unid": "d1-3", "mag": 9.0}), "b")
    assert read_store(spark, store).count() == 120


def test_a_broken_load_is_run_again(spark, make, tmp_path, monkeypatch):
    store = Store(str(tmp_path))
    take_in(spark, store, days(make, 2), "a", "latest")
    update = make(*[{"unid": f"d0-{i}", "time": START + timedelta(days=i % 3), "lastupdate": START + hours(1), "mag": 7.0} for i in range(20)])
    real, steps = stores._write_cells, []

    def fails_at(k):
        def write(path, frame):
            steps.append(path)
            if len(steps) == k:
                raise OSError("lost")
            real(path, frame)
        return write

    # It breaks off before the events, before the cells are cut, and before the summary.
    for k in (1, 2, 3):
        steps.clear()
        monkeypatch.setattr(stores, "_write_cells", fails_at(k))
        with pytest.raises(OSError):
            take_in(spark, store, update, "b", "latest")
        monkeypatch.setattr(stores, "_write_cells", real)
        with pytest.raises(RuntimeError, match="b"):
            take_in(spark, store, update, "c", "latest")
    take_in(spark, store, update, "b", "latest")
    assert read_store(spark, store).count() == 40
    assert read_store(spark, store).filter("mag = 7").count() == 20
    consistent(spark, store)


@pytest.mark.parametrize("config", [
    RetentionConfig(max_events=0, retention_days=3), RetentionConfig(max_events=50, retention_days=0),
    RetentionConfig(max_events=7, retention_days=2), RetentionConfig(max_events=5, retention_days=1, auto_cleanup=False),
    RetentionConfig(max_events=118, retention_days=0),
])
def test_retention_in_place(spark, make, tmp_path, config):
    events = days(make).unionByName(make({"unid": "t1", "time": None}, {"unid": "t2", "time": None}))
    store, as_of = Store(str(tmp_path)), START + timedelta(days=5, minutes=10)
    take_in(spark, store, events.filter(F.col("depth").isNotNull() & ~F.col("unid").endswith("3")), "a")
    take_in(spark, store, events, "b")
    before = files(store.events)
    upkeep.run_retention(spark, store, as_of, config)
    assert plain(read_store(spark, store)) == plain(apply_retention(events, as_of, config))
    consistent(spark, store)
    # At most one date by age and one by number is written again.
    kept = [p for p in files(store.events) if p in before]
    whole = {p.split("event_date=")[1][:10] for p in files(store.events)}
    assert len(whole) - len({p.split("event_date=")[1][:10] for p in kept}) <= 2
    # What is gone may come in again.
    take_in(spark, store, events, "c")
    assert read_store(spark, store).count() == events.count()
    consistent(spark, store)


def test_retention_after_a_load_and_clearing(spark, make, tmp_path):
    store = Store(str(tmp_path / "s"))
    config = RetentionConfig(max_events=30, retention_days=0)
    upkeep.load_events(spark, days(make), store, "a", as_of=START, retention=config)
    assert read_store(spark, store).count() == 30
    with pytest.raises(ValueError):
        upkeep.load_events(spark, days(make), store, "a", retention=config)
    log = tmp_path / "log"
    (log / "versions").mkdir(parents=True)
    upkeep.clear_all(spark, store, str(log))
    assert tuples(read_store(spark, store)) == [] and not (log / "versions").exists()
    consistent(spark, store)
    upkeep.load_events(spark, days(make, 1), store, "a", clear=True)
    assert read_store(spark, store).count() == 20


def test_bad_events_are_set_aside(spark, make, tmp_path):
    store = Store(str(tmp_path))
    batch = make({"unid": "ok"}, {"unid": "deep", "depth": 900.0}, {"unid": "x" * 101})
    for _ in range(2):
        upkeep.load_events(spark, batch, store, "a", check=True)
    assert [r["unid"] for r in read_store(spark, store).collect()] == ["ok"]
    rejects = spark.read.parquet(store.rejects).collect()
    assert sorted((r["unid"][:4], list(r["errors"])) for r in rejects) == [("deep", ["depth out of range"]), ("xxxx", ["unid too long"])]


def test_names_and_rules_are_checked(spark, make, tmp_path):
    store = Store(str(tmp_path))
    for load in ("", "-", "a/b", "a--b", "a=b", "*"):
        with pytest.raises(ValueError):
            take_in(spark, store, make(), load)
    with pytest.raises(ValueError):
        take_in(spark, store, make(), "a", "newest")
    take_in(spark, store, make(), "a")
    assert tuples(read_store(spark, store)) == []
    consistent(spark, store)


def test_own_state_that_no_sum_can_express(spark, make, tmp_path):
    """Distinct regions by a sketch: added, merged, and taken back with an update."""
    sketch = Measure(lambda: F.col("flynn_region"), F.hll_sketch_agg, F.hll_union_agg)
    everything = Processor("everything", {"all": lambda: F.lit(0)})
    store = Store(str(tmp_path), (everything, MAGNITUDE), {"n": MEASURES["n"], "regions": sketch})

    def regions():
        row = read_store_summary(spark, store).filter("processor = 'everything'").select("n", F.hll_sketch_estimate("regions").alias("r")).first()
        return row["n"], row["r"]

    take_in(spark, store, make(*[{"unid": f"a{i}", "flynn_region": f"R{i % 7}"} for i in range(50)]), "a", "latest")
    assert regions() == (50, 7)
    take_in(spark, store, make({"unid": "b", "flynn_region": "S"}, {"unid": "a0", "flynn_region": "T", "lastupdate": utc(2030, 1, 1)}), "b", "latest")
    assert regions() == (51, 9)
    take_in(spark, store, make({"unid": "b", "flynn_region": "T", "lastupdate": utc(2030, 1, 1)}), "c", "latest")
    assert regions() == (51, 8)


@pytest.mark.parametrize("order", ["time", "time-asc", "magnitude", "magnitude-asc"])
def test_pages_of_a_store(spark, make, tmp_path, monkeypatch, order):
    from temblor.operators import ordering

    monkeypatch.setattr(ordering, "SHORT_LIST", 3)
    store = Store(str(tmp_path))
    events = days(make, 4).unionByName(make({"unid": "t", "time": None}, {"unid": "m", "mag": None}))
    take_in(spark, store, events, "a")
    ordered = [r["unid"] for r in events.orderBy(*ordering.order_columns(order)).collect()]
    for offset, limit in ((0, 2), (27, 11), (75, 20)):
        found = [r["unid"] for r in stores.store_page(spark, store, order, limit, offset).collect()]
        assert found == ordered[offset : offset + limit]


def test_a_deep_page_opens_two_dates(spark, make, tmp_path):
    store = Store(str(tmp_path))
    take_in(spark, store, days(make, 6), "a")
    for path in files(store.events, ["05-03", "05-04"]):
        Path(path).write_bytes(b"not a table")
    found = [r["unid"] for r in stores.store_page(spark, store, "time-asc", 10, 55).collect()]
    assert found == [f"d2-{i}" for i in range(15, 20)] + [f"d3-{i}" for i in range(5)]


def test_running_medians(spark, make, tmp_path):
    store = Store(str(tmp_path), (WHOLE,), QUANTILES)
    take_in(spark, store, make(*[{"unid": f"a{i}", "mag": float(i), "depth": 3.0} for i in range(9)]), "a", "latest")
    assert tuples(results.running_medians(read_store_summary(spark, store))) == [(4.0, 3.0)]
    take_in(spark, store, make(*[{"unid": f"a{i}", "mag": 9.0, "lastupdate": utc(2030, 1, 1), "depth": None} for i in range(5)]), "b", "latest")
    median, depth = tuples(results.running_medians(read_store_summary(spark, store)))[0]
    assert median in (8.0, 9.0) and depth == 3.0


def test_rows_are_sorted_by_their_folders_first(spark, make, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    plans, parquet = [], DataFrameWriter.parquet

    def record(writer, path, *args, **kwargs):
        plans.append((path.rsplit("/", 1)[1], writer._df._jdf.queryExecution().analyzed().toString().split("\n")[0]))
        return parquet(writer, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", record)
    take_in(spark, Store(str(tmp_path / "s")), make({"unid": "a"}), "one")
    # A writer whose rows come in another order sorts them again.
    order = {folder: re.findall(r"(\w+)#\d+L? ASC", plan) for folder, plan in plans}
    assert order == {"ids": ["bucket", "load", "unid"], "events": ["event_date", "load", "time"], "summary": ["event_date", "load"]}
