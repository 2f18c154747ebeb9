"""Near-duplicates against all pairs of sets."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from temblor.llm import graph, near_dups
from temblor.llm.graph import components
from temblor.llm.near_dups import drop_near_duplicates, near_duplicates

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, []).append(shingles(text, size))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            new = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                new[rng.randrange(len(new))] = word()
            rows.append((len(rows), " ".join(new)))
    shared = " ".join(word() for _ in range(60))
    rows += [(len(rows) + i, shared + " " + " ".join(word() for _ in range(20))) for i in range(20)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one two"), (504, "ONE\ttwo"), (505, "É a b"), (506, "é a b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words, percent, chunks", [(3, 85, 6), (5, 80, 8)])
def test_components_equal_all_pairs(documents, words, percent, chunks):
    rows = corpus()
    result = near_duplicates(documents(*rows), words=words, percent=percent, chunks=chunks).collect()
    expected = brute(rows, words, percent)
    assert {r["doc_id"]: r["component_id"] for r in result} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in result} == {i: len(shingles(t, words)) for i, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in result)
    assert len(set(expected.values())) < len(expected) - 20


@pytest.mark.parametrize("tile", [16, 1_024])
def test_a_cloud_of_copies_with_loners(documents, monkeypatch, tile):
    """Copies with up to ten changed words: a third is linked with none, and pairs of one bucket lie on both sides
    of the bound. Small tiles make the cloud a large area."""
    monkeypatch.setattr(near_dups, "TILE", tile)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        new = list(base)
        for place in rng.sample(range(200), rng.randint(0, 10)):
            new[place] = f"x{rng.random()}"
        rows.append((i, " ".join(new)))
    rng.shuffle(rows)
    expected = brute(rows, 3, 85)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(*rows), words=3, percent=85, chunks=6).collect()}
    assert found == expected
    assert 30 < sum(i == c for i, c in expected.items()) < 120


def linked(sets, percent):
    """Exact links by the rarest shingles: sets that are similar enough share one of their first few."""
    often = Counter(s for one in sets.values() for s in one)
    at = defaultdict(list)
    links = set()
    for i, one in sets.items():
        ordered = sorted(one, key=lambda s: (often[s], s))
        first = ordered[: len(one) - -(-percent * len(one) // 100) + 1]
        for j in {j for s in first for j in at[s]}:
            both = len(one & sets[j])
            if 100 * both >= percent * (len(one) + len(sets[j]) - both):
                links.add((i, j))
        for s in first:
            at[s].append(i)
    return links


def test_whole_table_equals_an_exact_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sets, same = {}, {}
    for r in docs.orderBy("doc_id").collect():
        one = frozenset(shingles(r["text"], 3))
        same.setdefault(one, []).append(r["doc_id"])
    sets = {ids[0]: one for one, ids in same.items() if one}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = linked(sets, 85)
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    expected = {i: find(ids[0]) if one else i for one, ids in same.items() for i in ids}
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, words=3, percent=85, chunks=6).collect()}
    assert found == expected and len(links) > 50


def test_repeated_rows_null_ids_and_ids_with_two_texts(documents):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, a), (2, a), (3, b), (2, b), (None, a), (None, None), (7, None), (7, None)]
    result = near_duplicates(documents(*rows))
    found = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in result.collect())
    assert found == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False),
                     (3, 1, False), (7, 7, True), (7, 7, True)]
    kept = drop_near_duplicates(documents(*rows))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, ""), (-1, a), (1, a), (7, ""), (7, "")]


def test_empty_table_and_clashing_columns(documents, spark):
    assert near_duplicates(documents().limit(0)).collect() == []
    docs = documents((1, "a b c d e f"), (2, "a b c d e f")).withColumns(
        {"_rank": F.lit(1), "id": F.lit(2), "kept": F.lit(3), "key": F.lit(4)})
    assert drop_near_duplicates(docs).columns == docs.columns
    assert [r["doc_id"] for r in drop_near_duplicates(docs).collect()] == [1]


@pytest.mark.parametrize("block", [7, 500_000])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 501 + i) for i in range(50)]
    edges = spark.createDataFrame(chain + star + [(9, 9), (3, 2), (2, 3), (2, 1)], "a bigint, b bigint")
    found = {r["id"]: r["component"] for r in components(edges).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 551)} | {1: 1, 2: 1, 3: 1}
    assert components(edges.limit(0)).collect() == []


def test_pairs_are_confirmed_without_batches_for_python(spark):
    sets = spark.createDataFrame([(1, list(range(100))), (2, list(range(85))), (3, list(range(84)))], "rep bigint, shingles array<bigint>")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "a bigint, b bigint")
    confirmed = near_dups._confirmed(pairs, sets, 85)
    assert "MapInArrow" not in confirmed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["a"], r["b"]) for r in confirmed.collect()) == [(2, 1), (3, 2)]
