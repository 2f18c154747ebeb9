"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

Spark adds up the scatter of the distinct vectors around their mean, one small matrix for each task.
Its pivoted Cholesky factor L, triangular up to the order of its rows, has V = L L'. Rotations of
pairs of L's columns make them orthogonal; then L J = U S, so the columns' squared lengths are the
eigenvalues of V and the columns scaled to one its eigenvectors. V itself is never diagonalised, and
small eigenvalues keep their relative precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from temblor.llm.graph import settle
from temblor.llm.grid import Batches, add_up, matrix, on_grid

COMPONENTS = 4
_EPS = np.finfo(float).eps


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (d x rank) with V = L L'; each step takes the largest diagonal element that is left."""
    left = v.diagonal().astype(float).copy()
    least = len(v) * _EPS * max(left.max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    free = np.ones(len(v), bool)
    for _ in range(len(v)):
        p = int(np.argmax(np.where(free, left, -np.inf)))
        if left[p] <= least:
            break
        column = v[:, p].astype(float)
        for c in columns:
            column = column - c * c[p]
        free[p] = False
        root = np.sqrt(left[p])
        column = np.where(free, column / root, 0.0)
        column[p] = root
        columns.append(column)
        left = np.where(free, left - column * column, 0.0)
    return np.array(columns).T if columns else np.zeros((len(v), 0))


def _rounds(n: int):
    """All pairs of n places in rounds of disjoint pairs: the first stays, the others move on by one."""
    places = list(range(n)) + [-1] * (n % 2)
    half = len(places) // 2
    for _ in range(len(places) - 1):
        pairs = [(a, b) for a, b in zip(places[:half], reversed(places[half:])) if a >= 0 and b >= 0]
        yield np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        places = [places[0], places[-1], *places[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of ``factor @ factor.T``.

    Rotates pairs of columns until all are orthogonal to double precision. Each vector's largest
    component is positive.
    """
    a = factor.copy()
    rounds = list(_rounds(a.shape[1])) if a.shape[1] > 1 else []
    for _ in range(sweeps):
        turned = False
        for i, j in rounds:
            x, y = a[:, i], a[:, j]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            todo = np.abs(gamma) > _EPS * np.sqrt(alpha * beta)
            if not todo.any():
                continue
            turned = True
            i, j, x, y = i[todo], j[todo], x[:, todo], y[:, todo]
            zeta = (beta[todo] - alpha[todo]) / (2 * gamma[todo])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.sqrt(1 + t * t)
            a[:, i], a[:, j] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    values = (a * a).sum(0)
    order = np.argsort(-values, kind="stable")
    values, a = values[order], a[:, order]
    vectors = a / np.sqrt(values)
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))]) if len(values) else np.ones(0)
    return values, vectors * signs


def _sums(length: int):
    """Number and sums of the vectors of a task."""

    def add(batches: Batches) -> np.ndarray:
        total = np.zeros(length + 1, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), length)
            total[0] += len(x)
            total[1:] += x.sum(0)
        return total

    return add


def _scatter(length: int, mean: np.ndarray):
    """Centred scatter of a task, and as its last row what the centred vectors add up to."""

    def add(batches: Batches) -> np.ndarray:
        total = np.zeros((length + 1, length))
        for batch in batches:
            x = matrix(batch.column("x"), length) - mean
            total[:length] += x.T @ x
            total[length] += x.sum(0)
        return total.ravel()

    return add


def _products(length: int, mean: np.ndarray, turn: np.ndarray, centre: np.ndarray):
    k = turn.shape[1]

    def add(batches: Batches) -> np.ndarray:
        total = np.zeros((k, k))
        for batch in batches:
            w = (matrix(batch.column("x"), length) - mean) @ turn - centre
            total += w.T @ w
        return total.ravel()

    return add


@dataclass(frozen=True)
class Whitening:
    """What is learned from ``n`` distinct vectors with ``sums``: eigenvalues and unit components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float]
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))

    @property
    def turn(self) -> np.ndarray:
        """From centred to whitened vectors."""
        return self.vectors / np.sqrt(self.values)


def learn_whitening(rows: DataFrame, length: int, components: int = COMPONENTS) -> Whitening:
    """Over each distinct ``x`` of ``rows`` once. Matrices of length x length reach the driver."""
    fit = settle(rows.filter("x is not null").select("x").distinct())
    n, *sums = add_up(fit, _sums(length), exact=True) or [0] * (length + 1)
    if not n or not length:
        return Whitening(0, sums, np.zeros(0), np.zeros((length, 0)), [], 0.0)
    mean = np.array([s / n for s in sums])
    scatter = add_up(fit, _scatter(length, mean), exact=False).reshape(length + 1, length) / n
    v = (scatter[:length] + scatter[:length].T) / 2
    values, vectors = one_sided_jacobi(pivoted_cholesky(v))
    values, vectors = values[:components], vectors[:, :components]
    learned = Whitening(n, sums, values, vectors, [float(e / v.trace()) for e in values], 0.0)
    # The mean of the whitened vectors: what rounding has left of zero.
    centre = scatter[length] @ learned.turn
    k = len(values)
    covariance = add_up(fit, _products(length, mean, learned.turn, centre), exact=False).reshape(k, k) / n if k else np.zeros((0, 0))
    error = float(np.abs(covariance - np.eye(k)).max(initial=0.0))
    return Whitening(n, sums, values, vectors, learned.explained, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; None where a long cannot hold it."""
    widest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if len(sums) * widest * widest < 2**63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return [d if d < 2**63 else None for d in map(int, exact)]


def _whitener(learned: Whitening, length: int, shown: int):
    def whiten(batches: Batches) -> Batches:
        k = len(learned.values)
        for batch in batches:
            there = np.asarray(batch.column("x").is_valid())
            x = matrix(batch.column("x").drop_null(), length)
            white = np.full((len(there), shown), np.nan)
            white[np.ix_(there, np.arange(k))] = (x - learned.mean) @ learned.turn
            deviations = np.full(len(there), None, object)
            deviations[there] = _deviations(x, learned.n, learned.sums)
            each = np.repeat(np.arange(len(there)), shown)
            component = np.tile(np.arange(shown), len(there))
            flat = white.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(each)), pa.array(component + 1, pa.int32()),
                 pa.array(deviations[each], pa.int64()), pa.array(flat, mask=np.isnan(flat))],
                names=["id", "component", "deviation", "whitened"])

    return whiten


def whiten_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each sound row of
    ``vectors`` and each component from 1 to ``components`` (or the vectors' length, if less).

    Entries are grid steps x (``floor(256 * c)``). ``n`` counts the distinct vectors learned from, S is
    their sum; ``deviation`` is the sum of ``(n x - S)^2`` over the dimensions, ``whitened`` the centred
    vector along the component over the root of its eigenvalue, ``explained`` the eigenvalue's share of
    all variance, ``identity_error`` the largest distance of the whitened covariance from the identity.

    Rows whose vector is null or holds null or non-finite entries are dropped; copies and equal vectors
    are learned from once. A vector of another length than most, or with an entry beyond what longs can
    square exactly, is not learned from and has null deviation and whitened. Components beyond the
    rank of the covariance have null whitened and explained 0; a deviation that no long can hold is null.
    Rows without id and repeated ids are rows of their own. An empty table gives no rows. Other columns
    are not read.
    """
    rows, length = on_grid(vectors, vector_col, id=id_col)
    learned = learn_whitening(rows, length, components)
    shown = min(components, length)
    schema = T.StructType([rows.schema["id"], T.StructField("component", T.IntegerType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType())])
    explained = learned.explained + [0.0] * (shown - len(learned.explained))
    shares = F.array(*[F.lit(e) for e in explained]) if shown else F.array().cast("array<double>")
    return rows.mapInArrow(_whitener(learned, length, shown), schema).select(
        F.col("id").alias(id_col), "component", F.lit(learned.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(learned.identity_error).alias("identity_error"))
