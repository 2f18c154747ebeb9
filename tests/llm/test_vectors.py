"""Vector links against all pairs."""

import contextlib
import os
import threading

import numpy as np
import pytest

from temblor.llm import vector_dups

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    ids, links, root = [r[0] for r in rows], [0] * len(rows), list(range(len(rows)))

    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if sound(a) and sound(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return sorted((ids[i] if ids[i] is not None else -1, links[i], least[find(i)] if ids[i] is not None else -1) for i in range(len(rows)))


@pytest.mark.parametrize("tile", [1024, 7])
def test_links_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dups, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = []
    for group in range(14):
        centre = rng.normal(size=12)
        for _ in range(rng.integers(1, 18)):
            noisy = centre + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.2, 0.3, 0.6])
            rows.append((int(len(rows) * 3 % 1009), [float(np.float32(x * 10.0 ** rng.integers(-3, 4))) for x in noisy][:12], int(group % 3)))
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 12, 1), (2003, [None] + [1.0] * 11, 1), (2004, [float("nan")] * 12, 1),
             (2005, [float("inf")] * 12, 1), (2006, rows[0][1], None), (2007, rows[0][1][:5], 0), (None, rows[0][1], 0),
             (2008, rows[0][1], 0), (2009, rows[0][1], 0), (2010, [1.0], 0), (2011, [2.0], 0), (2012, [1e30] * 12, 2), (2013, [1e-30] * 12, 2)]
    result = vector_dups.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    found = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["vec_id"] is not None else -1) for r in result)
    assert found == brute(rows)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in result)


def test_empty_table(spark):
    assert vector_dups.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_double_vectors_and_text_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_dups, "TILE", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 10))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 9] + rng.normal(size=10) * 0.3], k % 2) for k in range(90)]
    texts = spark.createDataFrame([(i, v, f"label {c}") for i, v, c in rows], "vec_id bigint, embedding array<double>, label string")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dups.near_vectors(texts).collect()) == brute(rows)


class Written:
    """Bytes of the files that Spark writes meanwhile, those that it deletes again too."""

    def __init__(self, spark):
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        self.folders = [*manager.localDirsString(), spark.conf.get("spark.checkpoint.dir")]
        self.sizes, self.over = {}, threading.Event()

    def look(self):
        for folder in self.folders:
            for at, _, names in os.walk(folder):
                for name in names:
                    with contextlib.suppress(OSError):
                        path = f"{at}/{name}"
                        self.sizes[path] = max(self.sizes.get(path, 0), os.path.getsize(path))

    def watch(self):
        while not self.over.wait(0.02):
            self.look()

    def __enter__(self):
        self.look()
        self.before = sum(self.sizes.values())
        self.thread = threading.Thread(target=self.watch)
        self.thread.start()
        return self

    def __exit__(self, *_):
        self.over.set()
        self.thread.join()
        self.look()
        self.bytes = sum(self.sizes.values()) - self.before


def test_a_vector_is_written_a_few_times_however_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector_dups, "TILE", 128)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    x[1000:1100] = x[:100] * np.float32(1.5) + rng.normal(size=(100, 64)).astype(np.float32) * np.float32(0.2)
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], SCHEMA).repartition(4).localCheckpoint()
    with Written(spark) as written:
        result = {r["vec_id"]: r for r in vector_dups.near_vectors(table).collect()}
    assert written.bytes < 6 * x.nbytes
    assert all(r["n_links"] == (k < 100 or 1000 <= k < 1100) for k, r in result.items())
    assert all(result[k]["component_id"] == result[k + 1000]["component_id"] == k for k in range(100))


@pytest.mark.parametrize("kind", ["at the threshold", "groups", "few directions"])
@pytest.mark.parametrize("same", [True, False])
def test_blocks_equal_all_pairs(kind, same):
    rng = np.random.default_rng(10)
    n = 1300
    x = rng.normal(size=(2 * n, 40))
    if kind == "at the threshold":
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        away = rng.normal(size=(n, 40))
        x[n:] = x[:n] + away / np.sqrt((away * away).sum(1, keepdims=True)) * rng.normal(0.395, 0.01, size=(n, 1))
    elif kind == "groups":
        x = rng.normal(size=(20, 40))[rng.integers(0, 20, 2 * n)] + 0.27 * x
    else:
        x = x[:, :5] @ rng.normal(size=(5, 40)) + 0.02 * x
    x = x[rng.permutation(2 * n)].astype(np.float32)
    x[:n] = x[:n][vector_dups._near_order(vector_dups._units(x[:n]))]
    a, b = x[:n], x[:n] if same else x[n:]
    count_a, count_b = rng.integers(1, 4, n), rng.integers(1, 4, n)
    left = vector_dups._Side.of(a)
    links, root = vector_dups._compare(left, left if same else vector_dups._Side.of(b), count_a, count_b, 0.93)
    linked = vector_dups._units(a) @ vector_dups._units(b).T >= 0.93
    counts = count_a if same else np.concatenate([count_a, count_b])
    i, j = np.nonzero(np.triu(linked, 1) if same else linked)
    j = j if same else j + n
    assert len(i) > 50
    assert (links == np.bincount(i, counts[j], len(counts)) + np.bincount(j, counts[i], len(counts))).all()
    assert (root == vector_dups._joined(np.arange(len(counts)), i, j)).all()
