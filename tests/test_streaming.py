import json

import pytest
from pyspark.sql import functions as F

from helpers import hours, tuples, utc
from temblor.operators import geo, magnitude, temporal, versions
from temblor.operators.retention import RetentionConfig
from temblor.plans import summary as results
from temblor.plans.store import Store, read_store
from temblor.plans.processors import MAGNITUDE, Processor, merge_summaries, summarize
from temblor.schema import EVENT_SCHEMA
from temblor.sources import messages
from temblor.sources.event_table import read_events
from temblor.sources.geojson import empty_events
from temblor.streaming import incremental, ingest
from test_sources import feature

MINUTE = 60


def message(action, unid, mag, minute):
    stamp = f"2024-12-10T22:{minute:02d}:00Z"
    return json.dumps({"action": action, "data": feature(unid=unid, mag=mag, lastupdate=stamp)})


def land(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def run(spark, source, root):
    query = ingest.start_ingest(messages.stream_event_messages(spark, str(source), 1), str(root))
    assert query.awaitTermination(5 * MINUTE)


@pytest.fixture
def replay(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    land(source, "1.txt", message("create", "x", 0.9, 1), "broken", message("create", "y", 2.0, 2))
    run(spark, source, root)
    land(source, "2.txt", message("update", "x", 1.4, 5), message("create", "y", 2.0, 2))
    run(spark, source, root)
    return source, str(root)


def mags(frame):
    return {r["unid"]: r["mag"] for r in frame.collect()}


def test_first_and_latest(spark, replay):
    _, root = replay
    assert mags(ingest.read_current(spark, root, "first")) == {"x": 0.9, "y": 2.0}
    assert mags(ingest.read_current(spark, root)) == {"x": 1.4, "y": 2.0}
    assert [r["value"] for r in ingest.read_rejects(spark, root).collect()] == ["broken"]
    assert ingest.read_versions(spark, root).count() == 4
    sent = messages.parse_messages(ingest.read_emitted(spark, root))
    assert sorted(r["action"] for r in sent.collect()) == ["create", "create", "create", "update"]


def test_a_batch_written_twice_counts_once(spark, replay):
    _, root = replay
    paths = ingest.IngestPaths(root)
    before = sorted(tuples(ingest.read_versions(spark, root)))
    batch = spark.createDataFrame(
        [r for r in ingest.read_versions(spark, root).filter("batch_id = 1").collect()],
        ingest._LOG_SCHEMA,
    )
    ingest.write_batch(batch.drop("batch_id"), paths.log, 1)
    assert sorted(tuples(ingest.read_versions(spark, root))) == before


def test_a_subscriber_gets_the_accepted_messages(spark, tmp_path):
    source, seen = tmp_path / "in", []
    land(source, "1.txt", message("create", "x", 0.9, 1), "broken", message("update", "x", 1.0, 2))
    query = ingest.start_ingest(
        messages.stream_event_messages(spark, str(source)), str(tmp_path / "out"),
        emit=lambda sent, batch_id: seen.extend(json.loads(r["value"]) for r in sent.collect()),
    )
    assert query.awaitTermination(5 * MINUTE)
    assert sorted((m["action"], m["data"]["properties"]["mag"]) for m in seen) == [
        ("create", 0.9), ("update", 1.0)
    ]


def test_compaction(spark, replay, tmp_path):
    source, root = replay
    table = str(tmp_path / "table")
    ingest.compact(spark, root, table)
    assert mags(read_events(spark, table)) == {"x": 1.4, "y": 2.0}

    land(source, "3.txt", message("update", "y", 2.5, 9), message("create", "z", 4.0, 9))
    run(spark, source, root)
    later = str(tmp_path / "later")
    ingest.compact(spark, root, later, base=table, since=1)
    assert mags(read_events(spark, later)) == {"x": 1.4, "y": 2.5, "z": 4.0}


def test_stream_dedupe_passes_each_id_once(spark, tmp_path):
    source = tmp_path / "in"
    land(source, "1.txt", message("create", "x", 0.9, 1), message("create", "y", 2.0, 2))

    def step():
        good = messages.accepted(messages.stream_event_messages(spark, str(source), 1))
        good = good.select(*EVENT_SCHEMA.names)
        query = incremental.start_first_versions(good, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert query.awaitTermination(5 * MINUTE)
        return mags(incremental.read_first_versions(spark, str(tmp_path / "out"), EVENT_SCHEMA))

    assert step() == {"x": 0.9, "y": 2.0}
    land(source, "2.txt", message("update", "x", 1.4, 5), message("create", "z", 3.0, 1))
    assert step() == {"x": 0.9, "y": 2.0, "z": 3.0}


@pytest.fixture
def events(make):
    return make(
        mag=[0.5 + (i % 37) / 10 for i in range(120)],
        depth=[float(i % 50) for i in range(120)],
        lat=[30 + (i % 9) / 4 for i in range(120)],
        time=[utc(2024, 1, 1) + hours(i) for i in range(120)],
        flynn_region=["AB"[i % 2] for i in range(120)],
    ).unionByName(
        make(
            {"unid": "n1", "mag": None}, {"unid": "n2", "time": None},
            {"unid": "n3", "flynn_region": None},
        )
    )


def same(a, b):
    assert sorted(map(str, tuples(a))) == sorted(map(str, tuples(b)))


def test_stream_equals_batch(spark, events, tmp_path):
    table, partial = str(tmp_path / "table"), str(tmp_path / "partial")
    events.repartition(6).write.parquet(table)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(table)
    assert incremental.start_summaries(stream, partial, str(tmp_path / "cp")).awaitTermination(5 * MINUTE)
    assert spark.read.parquet(partial).select("batch_id").distinct().count() == 3

    summary = results.read_summary(spark, partial)
    same(results.magnitude_distribution(summary), magnitude.magnitude_distribution(events))
    same(results.magnitude_frequency(summary), magnitude.magnitude_frequency(events))
    same(results.daily_counts(summary), temporal.daily_counts(events))
    same(results.temporal_section(summary), temporal.temporal_section(events))
    same(results.hourly_frequency(summary), temporal.hourly_frequency(events))
    same(results.weekly_frequency(summary), temporal.weekly_frequency(events))
    same(results.region_hotspots(summary), geo.region_hotspots(events))
    same(results.coordinate_clusters(summary), geo.coordinate_clusters(events))
    same(results.region_stats(summary).select("flynn_region", "event_count"),
         geo.region_stats(events).select("flynn_region", "event_count"))
    row = results.data_stats(summary).first()
    assert (row["total_events"], row["memory_usage_estimate"]) == (123, 61500)

    target = str(tmp_path / "merged")
    incremental.compact_summaries(spark, partial, target)
    same(results.magnitude_distribution(results.read_summary(spark, target)),
         magnitude.magnitude_distribution(events))


def test_risk_of_a_summary_equals_the_scan(spark, events):
    from temblor.operators import risk

    summary = merge_summaries(summarize(events))
    a, b = results.risk_section(summary).first(), risk.risk_section(events).first()
    assert a["total_events"] == b["total_events"] == 122
    for name in (*risk.STANDARD_RISKS, "total_energy_joules"):
        assert a[name] == pytest.approx(b[name], rel=1e-12)


def test_summary_of_nothing(spark, tmp_path):
    path = str(tmp_path / "summary")
    results.recompute_all(empty_events(spark), path)
    summary = results.read_summary(spark, path)
    assert tuples(results.magnitude_distribution(summary)) == []
    assert tuples(results.gr_section(summary)) == [(1.0, 0.0, 2.0, 0)]
    assert tuples(results.risk_section(summary)) == [(0.0, 0.0, 0.0, 0.0, 0)]
    assert [n for _, n in tuples(results.weekly_frequency(summary))] == [0] * 7


def test_recompute_replaces(spark, events, tmp_path):
    path = str(tmp_path / "summary")
    results.recompute_all(events, path)
    results.recompute_all(events.filter("mag >= 2"), path)
    assert results.data_stats(results.read_summary(spark, path)).first()["total_events"] == (
        events.filter("mag >= 2").count()
    )


def test_own_processor_beside_the_built_in_ones(events):
    by_type = Processor("by_type", {"magtype": lambda: F.col("magtype")})
    summary = summarize(events, (MAGNITUDE, by_type))
    assert tuples(summary.filter("processor = 'by_type'").select("magtype", "n")) == [("mlw", 123)]
    with pytest.raises(ValueError):
        summarize(events, (by_type, by_type))


def test_versions(make):
    known = make({"unid": "a"}, {"unid": "b"})
    batch = make({"unid": "b", "mag": 5.0, "lastupdate": utc(2025, 1, 1)}, {"unid": "c"}, {"unid": "c"})
    assert [r["unid"] for r in versions.new_events_only(batch, known).collect()] == ["c"]
    assert mags(versions.add_events(known, batch)) == {"a": 2.0, "b": 2.0, "c": 2.0}
    assert versions.add_events(known, batch, dedupe=False).count() == 5
    assert mags(versions.upsert_events(known, batch)) == {"a": 2.0, "b": 5.0, "c": 2.0}
    assert mags(versions.upsert_events(known, batch, "first")) == {"a": 2.0, "b": 2.0, "c": 2.0}
    with pytest.raises(ValueError):
        versions.upsert_events(known, batch, "never")


def test_known_rows_come_first_and_rows_without_id_stay_apart(make):
    known = make({"unid": "a"}, {"unid": None}, {"unid": None})
    older = make({"unid": "a", "mag": 5.0, "lastupdate": utc(2020, 1, 1)}, {"unid": None}, {"unid": None})
    for rule in ("first", "latest"):
        result = versions.upsert_events(known, older, rule)
        assert [r["mag"] for r in result.filter("unid = 'a'").collect()] == [2.0]
        assert result.filter("unid is null").count() == 4
    tie = make({"unid": "a", "mag": 1.0})
    assert [r["mag"] for r in versions.upsert_events(known, tie).filter("unid = 'a'").collect()] == [1.0]
    assert versions.add_events(known, older).filter("unid is null").count() == 4


def test_known_table_is_not_shuffled_for_a_small_batch(spark, make, tmp_path):
    from temblor.sources.event_table import read_events, write_events

    write_events(make(*[{"unid": f"k{i}"} for i in range(50)]), str(tmp_path / "t"))
    known = read_events(spark, str(tmp_path / "t"))
    batch = make({"unid": "k3", "mag": 9.0})
    for result in (versions.upsert_events(known, batch), versions.upsert_events(known, batch, "first")):
        assert result.count() == 50
        scan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        for part in scan.split("FileScan parquet")[:-1]:
            # Between a scan of the known table and the first join there is no exchange of it.
            assert "SortMergeJoin" not in part


def test_a_followed_log_gives_up_replaced_versions(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "log")

    def step(name, *lines):
        land(source, name, *lines)
        query = ingest.start_ingest(messages.stream_event_messages(spark, str(source), 1), root)
        assert query.awaitTermination(5 * MINUTE)
        summary = incremental.refresh_summary(spark, root, f"{root}/summary")
        loads = spark.read.parquet(f"{root}/summary/summary").select("load").distinct().count()
        return {r["mag_key"]: r["n"] for r in results.magnitude_counts(summary).collect()}, loads

    assert step("1.txt", message("create", "x", 1.0, 1)) == ({10: 1}, 1)
    assert step("2.txt", message("create", "y", 2.0, 2)) == ({10: 1, 20: 1}, 2)
    # The first batch's only event is replaced, so its part goes.
    assert step("3.txt", message("update", "x", 3.0, 5)) == ({20: 1, 30: 1}, 2)
    # An older version loses; nothing new is followed by nothing.
    assert step("4.txt", message("update", "x", 4.0, 3))[0] == {20: 1, 30: 1}
    assert incremental.follow_log(spark, root, Store(f"{root}/summary")) == 3
    store = Store(f"{root}/summary")
    assert mags(read_store(spark, store)) == mags(ingest.read_current(spark, root)) == {"x": 3.0, "y": 2.0}
    # A newer event comes with retention: the two newest stay. All were at one time, so ids decide.
    land(source, "5.txt", message("create", "a", 5.0, 9))
    run(spark, source, root)
    config = RetentionConfig(max_events=2, retention_days=0)
    with pytest.raises(ValueError):
        incremental.follow_log(spark, root, store, retention=config)
    incremental.follow_log(spark, root, store, retention=config, as_of=utc(2024, 12, 11))
    assert mags(read_store(spark, store)) == {"a": 5.0, "x": 3.0}


def test_a_batch_of_the_dedupe_stream_reads_itself_and_its_state(spark, make, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    progress = []
    for k in range(4):
        # Ten new ids each time; a known id comes again; of two versions in one batch the older passes; one has no id.
        rows = [{"unid": f"e{k}-{i}", "mag": float(k)} for i in range(9)]
        rows += [{"unid": f"e{k}-x", "mag": 8.0, "lastupdate": utc(2024, 1, 2)}, {"unid": f"e{k}-x", "mag": 7.0, "lastupdate": utc(2024, 1, 1)},
                 {"unid": "e0-0", "mag": 9.0, "lastupdate": utc(2000, 1, 1)}]
        rows = rows if k else rows[:-1]
        make(*rows, {"unid": None}, {"unid": None}).coalesce(1).write.mode("append").parquet(source)
        query = incremental.start_first_versions(spark.readStream.schema(EVENT_SCHEMA).parquet(source), out, str(tmp_path / "cp"))
        assert query.awaitTermination(5 * MINUTE)
        progress += [p for p in query.recentProgress if p["numInputRows"]]
    passed = incremental.read_first_versions(spark, out, EVENT_SCHEMA).collect()
    found = {r["unid"]: r["mag"] for r in passed if r["unid"]}
    assert len(passed) == 48 and len(found) == 40 and found["e0-0"] == 0.0 and all(found[f"e{k}-x"] == 7.0 for k in range(4))
    # The state grows by the new ids and one row for events without; what a batch reads does not grow.
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress] == [11, 22, 33, 44]
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in progress] == [11, 12, 12, 12]
    assert [p["numInputRows"] for p in progress] == [13, 14, 14, 14]


def test_the_log_as_a_stream_tells_what_came_first(spark, replay, tmp_path):
    _, root = replay
    versions = ingest.stream_versions(spark, root)
    query = incremental.start_first_versions(versions, str(tmp_path / "u"), str(tmp_path / "cp"), order=ingest.ARRIVAL)
    assert query.awaitTermination(5 * MINUTE)
    assert mags(incremental.read_first_versions(spark, str(tmp_path / "u"), EVENT_SCHEMA)) == {"x": 0.9, "y": 2.0}


def test_equal_versions_give_one_result(make):
    pair = make({"unid": "a", "mag": 1.0}, {"unid": "a", "mag": 2.0})
    turned = make({"unid": "a", "mag": 2.0}, {"unid": "a", "mag": 1.0})
    assert mags(versions.latest_wins(pair)) == mags(versions.latest_wins(turned))


def test_messages_land_compressed_in_more_files_for_more_events(spark, tmp_path, monkeypatch):
    from checks import landing

    events = spark.range(60).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\":1}' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(0, "A")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    monkeypatch.setattr(landing, "FILE_ROWS", 5)
    assert landing.files_of_batch(spark, str(tmp_path)) == 2 * landing.FILES
    path = landing.landed_messages(spark, str(tmp_path))
    assert all(p.endswith(".gz") for p in spark.read.text(path).inputFiles())
    assert spark.read.text(path).count() == 60
    plan = landing._deal(events, 4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "Sort" not in plan


def test_only_bad_messages_keep_their_text_in_the_batch(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    kept, persist = [], DataFrame.persist

    def record(frame, *args):
        kept.extend((r["value"], r["error"] is None) for r in frame.select("value", "error").collect())
        return persist(frame, *args)

    monkeypatch.setattr(DataFrame, "persist", record)
    source, root = tmp_path / "in", str(tmp_path / "out")
    land(source, "1.txt", message("create", "x", 0.9, 1), "broken")
    run(spark, source, root)
    assert sorted(kept, key=str) == [("broken", False), (None, True)]
    assert [r["value"] for r in ingest.read_rejects(spark, root).collect()] == ["broken"]
    assert mags(ingest.read_versions(spark, root)) == {"x": 0.9}
