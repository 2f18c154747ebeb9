"""Codes and whitening against plain NumPy over all rows, and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from temblor.llm import vector_codes, whitening
from temblor.llm.grid import largest
from temblor.llm.vector_codes import Cells

D = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def grid(vectors):
    """(rows kept, integer vectors) the plain way."""
    kept = [r for r in vectors if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    return kept, np.array([[int(np.floor(256 * float(np.float32(c)))) for c in r[1]] for r in kept], np.int64)


def plain_codes(kept, x, parts=16, entries=64, rounds=2):
    edges = [k * x.shape[1] // parts for k in range(parts + 1)]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i].tolist()))[:entries]
    books, codes, error = [], np.zeros((len(x), parts), int), np.zeros(len(x), int)
    for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        part, book = x[:, a:b], x[first][:, a:b].copy()
        for r in range(rounds + 1):
            distance = ((part[:, None, :] - book[None, :, :]) ** 2).sum(2)
            near = distance.argmin(1)
            if r == rounds:
                break
            for e in range(len(book)):
                if (near == e).any():
                    book[e] = part[near == e].sum(0) // (near == e).sum()
        books.append(book)
        codes[:, p], error = near, error + distance.min(1)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    return ["".join(f"{c:02x}" for c in row) for row in codes], error, digest


def same_codes(frame, vectors, **options):
    kept, x = grid(vectors)
    codes, error, digest = plain_codes(kept, x, **options)
    labels = {}
    for r, e in zip(kept, error):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    expected = sorted(((r[0] is not None, r[0] or 0), c, int(e), labels[r[2]]) for r, c, e in zip(kept, codes, error))
    rows = vector_codes.compress_vectors(frame, **options).collect()
    assert sorted(((r["vec_id"] is not None, r["vec_id"] or 0), r["code"], r["error"], r["label_error"]) for r in rows) == expected
    assert {r["codebooks_sha256"] for r in rows} == {digest}


def test_codes_equal_plain_ones_on_a_whole_table(spark):
    frame = spark.read.parquet(f"{D}/embeddings.parquet")
    same_codes(frame, [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()])


def test_codes_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 0, 0.5]) + rng.random() * rng.choice([0, 0.01]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(90)]
    rows += [(500, None, 1), (501, [float("nan")] * 16, 1), (502, [float("inf")] * 16, 2), (503, [None] * 16, 2),
             (3, rows[3][1], 1), (3, rows[4][1], 9), (None, rows[5][1], None), (None, rows[6][1], None), (600, [-0.0] * 16, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"x": F.lit(1), "code": F.lit("c"), "id": F.lit(2)}).repartition(4)
    same_codes(frame, rows)
    same_codes(frame.filter("vec_id < 5"), [r for r in rows if r[0] is not None and r[0] < 5])
    # A length that the number of parts does not divide.
    same_codes(frame, rows, parts=5, entries=3, rounds=4)
    assert vector_codes.compress_vectors(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(frame, entries=300)


def test_vectors_that_do_not_fit(spark):
    rows = [(i, [i / 8.0] * 16, 1) for i in range(9)] + [(50, [0.5] * 15, 1), (51, [], 1), (52, [1e30] * 16, 2)]
    found = {r["vec_id"]: r for r in vector_codes.compress_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == 12 and all(found[i]["code"] is None and found[i]["error"] is None for i in (50, 51, 52))
    assert found[50]["label_error"] == sum(found[i]["error"] for i in range(9)) and found[52]["label_error"] is None
    white = whitening.whiten_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["n"] for r in white} == {9} and len(white) == 48
    assert all(r["deviation"] is None and r["whitened"] is None for r in white if r["vec_id"] >= 50)


@pytest.mark.parametrize("limit", [0, 10, 100_000])
@pytest.mark.parametrize("size", [1, 3, 8])
def test_cells_keep_every_nearest_entry(size, limit):
    """Ties, points far outside, equal entries, and a memory that holds none, few or all cells."""
    rng = np.random.default_rng(size)
    entries = rng.integers(-60, 60, (64, size))
    entries[7], entries[40:44] = entries[3], entries[39]
    points = np.vstack([rng.integers(-80, 80, (3000, size)), rng.integers(-10**6, 10**6, (200, size)), entries])
    cells = Cells(entries, limit)
    for _ in range(2):
        index, distance = cells.nearest(points)
        every = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert len(cells.known) <= limit
    if size == 3:
        found = cells.candidates(np.unique(points[:3000] >> cells.shift, axis=0))
        assert np.mean([len(f) for f in found]) < 24


def whitened(frame, vectors):
    kept, x = grid(vectors)
    fit = np.unique(x, axis=0).astype(float)
    n, sums = len(fit), np.unique(x, axis=0).sum(0)
    centred = fit - fit.mean(0)
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    rows = whitening.whiten_vectors(frame).collect()
    shown = min(4, x.shape[1])
    assert len(rows) == len(kept) * shown and {r["n"] for r in rows} == {n}
    expected = {}
    for r, v in zip(kept, x):
        expected.setdefault(r[0], []).append((int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))), v))
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    for k in range(shown):
        share = values[k] / values.sum()
        mine = [r for r in rows if r["component"] == k + 1]
        assert all(r["explained"] == pytest.approx(share, rel=1e-9) for r in mine)
        assert sorted((r["vec_id"] or 0, r["deviation"]) for r in mine) == sorted((i or 0, d) for i, e in expected.items() for d, _ in e)
        single = [r for r in mine if len(expected[r["vec_id"]]) == 1]
        plain = np.array([(expected[r["vec_id"]][0][1] - sums / n) @ vecs[:, k] / np.sqrt(values[k]) for r in single])
        found = np.array([r["whitened"] for r in single])
        assert min(np.abs(found - plain).max(), np.abs(found + plain).max()) < 1e-6


def test_whitening_equals_plain_eigenvectors(spark):
    frame = spark.read.parquet(f"{D}/embeddings.parquet")
    whitened(frame, [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()])


def test_whitening_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, s) for s in (3, 1, 0.5, 0.2, 0.1, 0.05)], 1) for i in range(80)]
    rows += [(i + 100, rows[i % 3][1], 1) for i in range(40)] + [(200, None, 1), (201, [float("nan")] * 6, 1), (202, [None] * 6, 2)]
    rows += [(None, rows[7][1], 1), (5, rows[9][1], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "component": F.lit(2), "x": F.lit(3)}).repartition(3)
    whitened(frame, rows)
    assert whitening.whiten_vectors(frame.limit(0)).collect() == []


def test_whitening_below_full_rank(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0, 1.0], 1) for i in range(10)]
    found = whitening.whiten_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    first = sorted((r["vec_id"], r["whitened"]) for r in found if r["component"] == 1)
    assert np.var([w for _, w in first]) == pytest.approx(1) and found[0]["identity_error"] < 1e-12
    assert all(r["whitened"] is None and r["explained"] == 0 for r in found if r["component"] > 1)
    alone = whitening.whiten_vectors(spark.createDataFrame(rows[:1] * 3, SCHEMA)).collect()
    assert len(alone) == 12 and {(r["n"], r["deviation"], r["whitened"]) for r in alone} == {(1, 0, None)}


def test_cholesky_and_jacobi_on_hard_matrices():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    for values in (np.logspace(0, -12, 40), np.ones(40), np.array([5.0] * 3 + [1.0] * 7 + [0.0] * 30)):
        v = (q * values) @ q.T
        factor = whitening.pivoted_cholesky((v + v.T) / 2)
        found, vectors = whitening.one_sided_jacobi(factor)
        assert np.allclose(found, np.sort(values)[::-1][: len(found)], rtol=1e-6, atol=1e-14)
        assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-9)
        assert np.allclose((vectors * found) @ vectors.T, v, atol=1e-12)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_deviations_beyond_a_long_are_exact_or_null():
    x = np.array([[10**6, -3], [0, 0], [7, 10**9]])
    n, sums = 10**9, [5 * 10**9, -(10**10)]
    plain = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    assert whitening._deviations(x, n, sums) == [d if d < 2**63 else None for d in plain]
    assert whitening._deviations(x, 3, [1, 2]) == [sum((3 * int(a) - s) ** 2 for a, s in zip(row, (1, 2))) for row in x.tolist()]
    assert largest(64) * 2 * largest(64) * 2 * 64 < 2**63
