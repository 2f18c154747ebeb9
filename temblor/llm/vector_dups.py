"""Near-duplicate vectors by comparing tiles of a label, each written once.

Vectors of one label and length are dealt by hash to tiles of at most ``TILE``; labels with fewer share
tiles. A vector is shuffled once, to its tile, and the tiles of labels that have several are kept
once in the shared folder. A task reads two tiles of a label, so what is written grows with the
table, however many tiles a label has. Links are counted and joined inside the task; pairs are never
written.

Inside a task vectors are scaled to length 1 and rotated to the principal directions of the two tiles.
With the leading coordinates ``a`` and what is left ``b``, the cosine of ``x`` and ``y`` is at most
``xa . ya + |xb| |yb|``: a product of few columns rules out nearly all pairs, and blocks whose boxes are
too far apart aren't multiplied. What is left is worked out in full, in single precision, and again in
double where that is too close to tell. So every link is found and counted once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from temblor.llm.graph import components, settle

TILE, TILE_BYTES = 65_536, 32 << 20  # vectors of a tile at most, and their bytes
LEAST, TASKS = 1_024, 32  # smaller tables get about so many tiles, of so many vectors at least
BLOCK = 512  # vectors that are multiplied with as many others at a time
_COLUMNS = (8, 12, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1_024)
_WAITING = 200_000  # links that wait until they are joined
_FOUND = ("num", "h1", "h2", "rep", "n", "links", "root")
Pairs = Iterator[tuple[bytes, bytes]]


def _units(raw: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very large or small numbers would overflow or vanish.
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _distinct(h1: np.ndarray, h2: np.ndarray, rep: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row with the smallest id of each (h1, h2), and the sums of ``n``."""
    order = np.lexsort((rep, h2, h1))
    a, b = h1[order], h2[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return order[first], np.add.reduceat(n[order], first)


def _thinner(width: int):
    """Equal vectors of a batch as one row; a common vector doesn't fill its tile's task."""
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("embedding")
            edges = np.asarray(lists.offsets).astype(np.int64)
            flat = np.ascontiguousarray(np.asarray(lists.flatten()))
            edges = ((edges - edges[0]) * width).astype(np.int32)
            vectors = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(edges), pa.py_buffer(flat)])
            names = ["tile", "l1", "l2", "h1", "h2"]
            h1, h2, ids = (np.asarray(batch.column(c)) for c in ("h1", "h2", "id"))
            rows, n = _distinct(h1, h2, ids, np.ones(len(ids), np.int64))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in names] + [pa.array(ids[rows]), pa.array(n), vectors.take(at)],
                names=[*names, "rep", "n", "vector"])

    return thin


def _near_order(units: np.ndarray) -> np.ndarray:
    """Vectors that are near each other next to each other: halves along the widest of the leading directions."""
    _, q = np.linalg.eigh(units.T @ units)
    lead = units @ q[:, ::-1][:, :8]
    parts, done = [np.arange(len(units))], []
    while parts:
        part = parts.pop()
        if len(part) <= BLOCK:
            done.append(part)
            continue
        x = lead[part]
        # Whole blocks on the left, so that blocks are the parts.
        half = -(-len(part) // BLOCK) // 2 * BLOCK
        order = np.argpartition(x[:, x.var(0).argmax()], half)
        parts += [part[order[half:]], part[order[:half]]]
    return np.concatenate(done)


def _packer(width: int):
    """One row for each tile: its classes of equal vectors, sorted by label and length."""
    kind = np.float32 if width == 4 else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        vectors = pa.chunked_array([c.cast(pa.large_binary()) for c in table.column("vector").chunks]).combine_chunks()
        tiles, l1, l2, h1, h2, rep, n = (table.column(c).to_numpy() for c in ("tile", "l1", "l2", "h1", "h2", "rep", "n"))
        table = batches = None
        for tile in np.unique(tiles):
            mine = np.flatnonzero(tiles == tile)
            first, counts = _distinct(h1[mine], h2[mine], rep[mine], n[mine])
            rows = mine[first]
            sizes = np.diff(_edges(vectors))[rows] // width
            order = np.lexsort((sizes, l2[rows], l1[rows]))
            heads = np.stack([l1[rows], l2[rows], sizes, h1[rows], h2[rows], rep[rows], counts])
            for a, b in _groups(heads[:, order]):
                if b - a > BLOCK:
                    raw = _bytes(vectors.take(pa.array(rows[order[a:b]]))).view(kind).reshape(b - a, -1)
                    order[a:b] = order[a:b][_near_order(np.concatenate([_units(raw[k : k + 8192]) for k in range(0, b - a, 8192)]))]
            flat = _bytes(vectors.take(pa.array(rows[order])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([tile]), pa.array([np.ascontiguousarray(heads[:, order]).tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())],
                names=["tile", "heads", "flat"])

    return pack


def _edges(vectors: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(vectors.buffers()[1], np.int64)[vectors.offset : vectors.offset + len(vectors) + 1]


def _bytes(vectors: pa.LargeBinaryArray) -> np.ndarray:
    edges = _edges(vectors)
    return np.frombuffer(vectors.buffers()[2], np.uint8)[edges[0] : edges[-1]]


def _groups(heads: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each label and length in sorted classes."""
    keys = heads[:3]
    edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), keys.shape[1]]
    return list(zip(edges[:-1], edges[1:]))


class _Side:
    """The vectors of one label and length, scaled and, with a ``basis``, rotated."""

    def __init__(self, raw: np.ndarray, units: np.ndarray) -> None:
        self.raw, self.units = raw, units
        self.starts = np.arange(0, len(raw), BLOCK)

    @classmethod
    def of(cls, raw: np.ndarray) -> _Side:
        units = np.empty(raw.shape, np.float32)
        for k in range(0, len(raw), 8192):
            units[k : k + 8192] = _units(raw[k : k + 8192])
        return cls(raw, units)

    def rotate(self, basis: np.ndarray | None, columns: int) -> None:
        """``short``: the leading coordinates and the length of what is left. ``low`` and ``high``: the boxes of the blocks."""
        if basis is None:
            self.short = self.units
            return
        size = self.units.shape[1]
        self.short = np.empty((len(self.units), columns + (columns < size)), np.float32)
        self.low, self.high = np.empty((2, len(self.starts), size), np.float32)
        for b, k in enumerate(self.starts):
            turned = self.units[k : k + BLOCK] @ basis
            self.low[b], self.high[b] = turned.min(0), turned.max(0)
            self.short[k : k + BLOCK, :columns] = turned[:, :columns]
            if columns < size:
                self.short[k : k + BLOCK, columns] = np.sqrt((turned[:, columns:] ** 2).sum(1))


def _plan(x: _Side, y: _Side, cosine: float, slack: float) -> tuple[np.ndarray | None, int]:
    """The directions to compare along, and how many of them first: those that cost least on some of the pairs.

    They change the time that it takes and not what is found.
    """
    size = x.units.shape[1]
    if len(x.raw) <= BLOCK and len(y.raw) <= BLOCK or size < 8:
        return None, size
    second = x.units.T @ x.units
    if y is not x:
        second = second + y.units.T @ y.units
    basis = np.ascontiguousarray(np.linalg.eigh(second.astype(np.float64))[1][:, ::-1]).astype(np.float32)
    a, b = x.units[:: 2 * (len(x.raw) // 2_048) + 2] @ basis, y.units[1 :: 2 * (len(y.raw) // 2_048) + 2] @ basis
    bulk, costs = np.zeros((len(a), len(b)), np.float32), {}
    rest = [1 - np.cumsum(z * z, 1) for z in (a, b)]
    at = 0
    for k in [*(c for c in _COLUMNS if c < size), size]:
        bulk += a[:, at:k] @ b[:, at:k].T
        at = k
        left = [np.sqrt(np.maximum(r[:, k - 1], 0)) * (k < size) for r in rest]
        passed = (bulk + np.outer(*left) >= cosine - slack).mean()
        # Nanoseconds of a pair: product and maximum, what blocks and rows with pairs that pass take, and these pairs.
        some = [1 - (1 - passed) ** n for n in (BLOCK * BLOCK, BLOCK)]
        costs[k] = 0.5 + 0.028 * k + 0.15 * some[0] + 3 * some[1] + passed * (60 if k < size else 15)
    return basis, min(costs, key=costs.get)


def _links(x: _Side, y: _Side, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Index pairs with the wanted cosine, block by block; ``x is y`` gives each pair once.

    With True they are two runs of indices of which each one links with all of the other.
    """
    size = x.units.shape[1]
    # More than single precision loses in the sums of a product.
    slack = 1e-6 * (size + 16) ** 0.5 + 2e-7 * size
    basis, columns = _plan(x, y, cosine, slack)
    for side in {id(x): x, id(y): y}.values():
        side.rotate(basis, columns)
    bound = np.float32(cosine - slack)
    room = np.empty((BLOCK, BLOCK), np.float32)
    for p, at in enumerate(x.starts):
        a = x.short[at : at + BLOCK]
        if basis is None:
            near = range(len(y.starts))
        else:
            gaps = np.maximum(np.maximum(y.low - x.high[p], x.low[p] - y.high), 0)
            near = np.flatnonzero((gaps.astype(np.float64) ** 2).sum(1) <= 2 - 2 * cosine + 4 * slack)
        for q in near:
            if x is y and q < p:
                continue
            to = y.starts[q]
            b = y.short[to : to + BLOCK]
            product = np.matmul(a, b.T, out=room[: len(a), : len(b)])
            rows = np.flatnonzero(product.max(1) >= bound)
            if not len(rows):
                continue
            if columns == size and (x is not y or p != q) and product.min() > cosine + slack:
                yield np.arange(at, at + len(a)), np.arange(to, to + len(b)), True
                continue
            i, j = np.nonzero(product[rows] >= bound)
            i = rows[i]
            one, two = x.units[at : at + BLOCK], y.units[to : to + BLOCK]
            if columns == size:
                near_to = product[i, j]
            elif len(i) > product.size // 32:
                product = one @ two.T
                if (x is not y or p != q) and product.min() > cosine + slack:
                    yield np.arange(at, at + len(a)), np.arange(to, to + len(b)), True
                    continue
                i, j = np.nonzero(product >= bound)
                near_to = product[i, j]
            else:
                near_to = np.concatenate([np.einsum("ij,ij->i", one[i[k : k + 8192]], two[j[k : k + 8192]]) for k in range(0, len(i), 8192)])
            keep = near_to >= bound
            if x is y and p == q:
                keep &= i < j
            i, j, near_to = i[keep] + at, j[keep] + to, near_to[keep]
            open_ = np.flatnonzero(near_to <= cosine + slack)
            if len(open_):
                exact = np.concatenate([
                    np.einsum("ij,ij->i", _units(x.raw[i[k]]), _units(y.raw[j[k]])) >= cosine
                    for k in np.split(open_, range(8192, len(open_), 8192))])
                keep = np.ones(len(i), bool)
                keep[open_[~exact]] = False
                i, j = i[keep], j[keep]
            if len(i):
                yield i, j, False


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links between ``a`` and ``b``; every root is the smallest of its component."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def _compare(x: _Side, y: _Side, nx: np.ndarray, ny: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links counted with their numbers of equal vectors, and roots, of the classes of ``x`` and, if it is another side, ``y``."""
    shift = 0 if x is y else len(nx)
    n = nx if x is y else np.concatenate([nx, ny])
    links, root = np.zeros(len(n)), np.arange(len(n))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def join() -> None:
        nonlocal root, size
        if waiting:
            root = _joined(root, *(np.concatenate([w[k] for w in waiting]) for k in (0, 1)))
            waiting.clear()
            size = 0

    for i, j, whole in _links(x, y, cosine):
        j = j + shift
        if whole:
            links[i] += n[j].sum()
            links[j] += n[i].sum()
            # All of one with the first of the other, and its first with all of the other.
            i, j = np.concatenate([i, np.full(len(j), i[0])]), np.concatenate([np.full(len(i), j[0]), j])
        else:
            for here, there in ((i, j), (j, i)):
                first = here.min()
                # Ends of a block's links lie within a block.
                counts = np.bincount(here - first, n[there])
                links[first : first + len(counts)] += counts
        apart = root[i] != root[j]
        if apart.any():
            waiting.append((i[apart], j[apart]))
            size += len(waiting[-1][0])
            if size > _WAITING:
                join()
    join()
    return links.astype(np.int64), root


def _tile_pairs(cosine: float, width: int):
    """The links of pairs of tiles, or of a tile with itself, as rows of ``_FOUND``."""
    kind = np.float32 if width == 4 else np.float64

    def opened(tile: bytes):
        number, heads, flat = pickle.loads(tile)
        heads = np.frombuffer(heads, np.int64).reshape(7, -1)
        flat = np.frombuffer(flat, kind)
        ends = np.concatenate([[0], np.cumsum(heads[2])])
        parts = {tuple(heads[:3, a].tolist()): (a, heads[:, a:b], flat[ends[a] : ends[b]].reshape(b - a, -1)) for a, b in _groups(heads)}
        return number, parts

    def rows(pairs: Pairs) -> Iterator[tuple[bytes]]:
        for one, two in pairs:
            number, parts = opened(one)
            other, others = (number, parts) if one is two or one == two else opened(two)
            if number == other:
                others = parts
            for key in parts.keys() & others.keys():
                at, heads, raw = parts[key]
                at_other, heads_other, raw_other = others[key]
                nums = (number << 32) + at + np.arange(len(raw))
                same = number == other
                if same:
                    every, full = nums, heads
                else:
                    every = np.concatenate([nums, (other << 32) + at_other + np.arange(len(raw_other))])
                    full = np.concatenate([heads, heads_other], 1)
                if same and len(raw) == 1:
                    links, root = np.zeros(1, np.int64), np.zeros(1, np.int64)
                else:
                    x = _Side.of(raw)
                    y = x if same else _Side.of(raw_other)
                    links, root = _compare(x, y, heads[6], heads_other[6], cosine)
                # Classes of several equal rows are told once, links or not.
                found = np.flatnonzero((links > 0) | (same & (full[6] > 1)))
                if len(found):
                    yield (np.stack([every[found], *full[3:, found], links[found], every[root[found]]], 1).tobytes(),)

    return rows


def _opened_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("found"):
            rows = np.frombuffer(value.as_buffer(), np.int64).reshape(-1, len(_FOUND))
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(rows[k : k + 10_000].T)], names=_FOUND)


def _pairs_of(tiles: RDD, n: int, wanted: list[tuple[int, int]]) -> RDD:
    """The wanted pairs of ``n`` partitions, a task each. Tiles are kept once, in the folder that
    ``settle`` has set, and read by each task that needs them."""
    context = tiles.context
    if tiles.getNumPartitions() != n:
        raise RuntimeError(f"{tiles.getNumPartitions()} partitions for {n} tiles")
    tiles.checkpoint()
    # Any job ends with writing what is marked.
    context.runJob(tiles.map(len), lambda lengths: [0], [0])
    every = tiles.cartesian(tiles)
    numbers = context._jvm.PythonUtils.toSeq([i * n + j for i, j in wanted]).toSet()
    some = context._jvm.org.apache.spark.rdd.PartitionPruningRDD.create(every._jrdd.rdd(), numbers)
    return RDD(some.toJavaRDD(), context, every._jrdd_deserializer)


def _tiled(sound: DataFrame, width: int) -> tuple[DataFrame, int, list[tuple[int, int]]]:
    """(``sound`` with ``tile``, number of tiles, the pairs of tiles that share a label)."""
    sizes = settle(sound.groupBy("label", "dimensions").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(1, min(TILE, max(LEAST, total // TASKS)))
    parts = F.ceil(F.greatest(F.col("n") / most, F.col("n") * F.col("dimensions") * width / TILE_BYTES))
    sizes = sizes.withColumn("parts", parts)
    few = sizes.filter("parts <= 1").agg(F.sum("n"), F.sum(F.col("n") * F.col("dimensions")) * width).first()
    shared = max(1, -(-(few[0] or 0) // most), -(-(few[1] or 0) // TILE_BYTES))
    # No more of these labels than the table has tiles.
    before = F.sum("parts").over(Window.orderBy("label", "dimensions").rowsBetween(Window.unboundedPreceding, -1))
    large = settle(sizes.filter("parts > 1").select("label", "dimensions", "parts", (F.coalesce(before, F.lit(0)) + shared).alias("base")))
    spans = [(r["base"], r["base"] + r["parts"]) for r in large.select("base", "parts").collect()]
    tile = F.coalesce(F.col("base") + F.pmod("h1", "parts"), F.pmod("l1", F.lit(shared)))
    tiled = sound.join(F.broadcast(large), ["label", "dimensions"], "left").withColumn("tile", tile)
    cross = [(i, j) for a, b in spans for i in range(a, b) for j in range(i + 1, b)]
    return tiled, max([shared, *(b for _, b in spans)]), cross


def near_vectors(
    vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Two vectors link if their labels are equal and not null, their lengths are equal and their
    cosine in double precision is at least ``cosine``. Vectors that are null, empty, zero or hold a
    null or non-finite component, and rows without id, link with nothing; the latter have a null
    component and are kept. Equal vectors of a label are compared once and link with each other.
    Rows that repeat an id are vectors of their own. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    # ``x - x`` is 0 for finite numbers only.
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (x - x == 0)) & F.exists(v, lambda x: x != 0)
    single = isinstance(vectors.select(v).schema[0].dataType.elementType, FloatType)
    width = 4 if single else 8
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"),
        (v if single else v.cast("array<double>")).alias("embedding"), F.size(v).alias("dimensions"),
        (F.coalesce(sound, F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).alias("sound"))
    keys = {f"{c}{k}": F.xxhash64(F.lit(k), *columns) for c, columns in (
        ("l", ("dimensions", "label")), ("h", ("dimensions", "label", "embedding"))) for k in (1, 2)}

    tiled, n_tiles, cross = _tiled(rows.filter("sound").withColumns(keys), width)
    numbers = "tile bigint, l1 bigint, l2 bigint, h1 bigint, h2 bigint"
    thin = tiled.select("tile", *keys, "id", "embedding").mapInArrow(_thinner(width), f"{numbers}, rep bigint, n bigint, vector binary")
    packed = thin.repartitionById(n_tiles, F.col("tile").cast("int")).mapInArrow(_packer(width), "tile bigint, heads binary, flat binary")
    tiles = packed.rdd.map(lambda r: pickle.dumps((r[0], bytes(r[1]), bytes(r[2])), 5))
    if cross:
        pairs = _pairs_of(tiles, n_tiles, [(k, k) for k in range(n_tiles)] + cross)
    else:
        pairs = tiles.map(lambda t: (t, t))
    found = settle(spark.createDataFrame(pairs.mapPartitions(_tile_pairs(cosine, width)), "found binary").mapInArrow(
        _opened_rows, ", ".join(f"{c} bigint" for c in _FOUND)))

    groups = components(found.select(F.col("num").alias("a"), F.col("root").alias("b")))
    # Classes with links or of several rows; all others stand for one row and are alone.
    known = found.groupBy("num", "h1", "h2", "rep", "n").agg(F.sum("links").alias("links"))
    known = settle(known.join(groups, F.col("num") == F.col("id"), "left").select(
        "h1", "h2", "rep", (F.col("n") - 1 + F.col("links")).alias("links"), F.coalesce("component", "num").alias("group")))
    least = known.groupBy("group").agg(F.min("rep").alias("component"))
    known = known.join(least, "group").select("h1", "h2", "links", "component")
    own = rows.filter("sound").select("id", keys["h1"].alias("h1"), keys["h2"].alias("h2"))
    sound_rows = own.join(known, ["h1", "h2"], "left").select(
        "id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    others = rows.filter("not sound").select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return sound_rows.union(others).select(
        F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
