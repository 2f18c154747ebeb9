"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A signature has ``chunks * WIDTH`` components of 16 bits. Two signatures that differ in at most
``2 * chunks - 1`` components have, by pigeonhole, a chunk with at most one differing component, so
they share one of the keys that leave one component of a chunk out. These keys are the index:
``chunks * WIDTH`` rows for each distinct set. Pairs that share a key and pass a looser bound on the
whole signature are confirmed on the full shingle sets.

No bucket is expanded into its pairs. Every member of a bucket is first compared with the bucket's
smallest member; what that connects is one component and needs no further comparison. Components that
still share a bucket make an area. An area's largest component is never compared with itself; all its
other members are compared with each other and with the largest component's, tile by tile inside
tasks: by the bounds that set sizes give, then by a sketch of 1,024 bins, then on the full sets. A
task joins as it goes, compares nothing that it has joined, and returns at most one link for each
member, so pairs are never written. The comparisons of an area grow with the members outside its
largest component times all its members; the rows that are moved grow with the tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from temblor.llm.graph import components, settle
from temblor.llm.words import Words, digest, distinct_sets, text_slices

WIDTH = 5
BINS = 1_024
TILE, TILE_BYTES = 1_024, 32 << 20  # members of a tile, and bytes of their sets, on average
FEW = 500_000  # so many representatives (two longs each) are sent to all tasks at most
_LANES = 4  # 16-bit components in a long
_SEEDS = np.random.default_rng(7_919).integers(1, 2**63, (2, 256), dtype=np.uint64)
_PROFILE = "id bigint, text_hash bigint, n_shingles bigint, d1 bigint, d2 bigint, signature array<bigint>"


def _signatures(hashes: np.ndarray, starts: np.ndarray, components_: int) -> np.ndarray:
    """16-bit MinHash components; one row for each start."""
    out = np.empty((len(starts), components_), np.uint16)
    for k in range(components_):
        values = hashes * (_SEEDS[0, k] | np.uint64(1)) + _SEEDS[1, k]
        # The low bits of a minimum are as good as random; the high ones are nearly all zero.
        least = np.minimum.reduceat(values, starts)
        out[:, k] = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
    return out


def _profiler(words: int, chunks: int):
    size = chunks * WIDTH
    lanes = -(-size // _LANES) * _LANES

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ones, twos, signatures = [], [], [], []
            for _, raw, offsets in text_slices(batch.column("text")):
                hashes, bounds = Words(raw, offsets).shingles(words)
                filled = np.flatnonzero(np.diff(bounds))
                packed = np.zeros((len(offsets) - 1, lanes), np.uint16)
                if len(filled):
                    packed[filled, :size] = _signatures(hashes, bounds[:-1][filled], size)
                signatures.append(packed.view(np.int64))
                for one in distinct_sets(hashes, bounds):
                    counts.append(len(one))
                    a, b = digest(one)
                    ones.append(a)
                    twos.append(b)
            width = lanes // _LANES
            flat = np.concatenate(signatures).ravel() if signatures else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(0, len(counts) * width + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(counts, pa.int64()),
                 pa.array(ones, pa.int64()), pa.array(twos, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(flat))],
                names=["id", "text_hash", "n_shingles", "d1", "d2", "signature"])

    return profile


def _indexer(chunks: int):
    """(key, rep) for each chunk and each component left out of it."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            longs = np.asarray(batch.column("signature").flatten())
            parts = longs.reshape(n, -1).view(np.uint16).astype(np.uint64)
            keys = []
            for chunk in range(chunks):
                part = parts[:, chunk * WIDTH : (chunk + 1) * WIDTH]
                for left_out in range(WIDTH):
                    rest = np.delete(part, left_out, axis=1)
                    key = np.zeros(n, np.uint64)
                    for j in range(WIDTH - 1):
                        key = (key << np.uint64(16)) | rest[:, j]
                    place = (chunk * WIDTH + left_out + 1) * 0xD1342543DE82EF95 % 2**64
                    keys.append((key ^ np.uint64(place)).view(np.int64))
            names = [f for f in batch.schema.names if f != "signature"]
            for key in keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key)] + [batch.column(f) for f in names], names=["key"] + names)

    return index


def _distance(a: str, b: str, longs: int) -> Column:
    """Differing 16-bit components of two packed signatures."""
    total = F.lit(0)
    for i in range(longs):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def _setter(words: int):
    """The sorted shingle hashes of a text."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for _, raw, offsets in text_slices(batch.column("text")):
                hashes, bounds = Words(raw, offsets).shingles(words)
                found = distinct_sets(hashes, bounds)
                edges = np.cumsum([0] + [len(s) for s in found], dtype=np.int32)
                flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, len(found)), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], names=["id", "shingles"])
                row += len(found)

    return sets


def _sets_of(reps: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) for the classes that the ``reps`` stand for. Few of them are sent to the texts' readers;
    otherwise the texts are shuffled once."""
    wanted = settle(reps.join(classes.select("rep", "rep_hash"), "rep").select(F.col("rep").alias("id"), F.col("rep_hash").alias("text_hash")))
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    # The same text may stand in several rows of an id.
    full = texts.join(wanted, ["id", "text_hash"], "left_semi").select("id", "text")
    return full.mapInArrow(_setter(words), "id bigint, shingles array<bigint>").withColumnRenamed("id", "rep")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives whose full sets are similar enough. Both sets of a pair meet row by row:
    batches of them for Python would hold thousands."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return alike.filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("sizes") - F.col("both"))).select("a", "b").distinct()


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One byte of the smallest hash in each of ``BINS`` equal ranges; 0 for an empty one. Sets are sorted."""
    out = np.zeros((len(sets), BINS), np.uint8)
    for row, values in zip(out, sets):
        bins = (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        row[bins[first]] = (values[first] % np.uint64(255)).astype(np.uint8) + 1
    return out


def _tile_links(percent: int):
    """Links (a, b) between components, as many as join them, of one task's areas."""
    least = percent / 100

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        area, side = np.asarray(table.column("area")), np.asarray(table.column("side"))
        reps, root = np.asarray(table.column("rep")), np.asarray(table.column("component")).copy()
        lists = table.column("shingles").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        flat, edges = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
        sets = [flat[x:y] for x, y in zip(edges[:-1], edges[1:])]
        sizes = np.array([len(s) for s in sets])
        alone = table.column("alone")[0].as_py()
        links: list[tuple[int, int]] = []
        order = np.argsort(area, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(area[order])) + 1):
            left, right = (members, members) if alone else (members[side[members] == 0], members[side[members] == 1])
            if len(left) and len(right):
                _join_rows(left, right, sets, sizes, root, least, percent, links)
        return pa.table({"a": pa.array([reps[i] for i, _ in links], pa.int64()), "b": pa.array([reps[j] for _, j in links], pa.int64())})

    return compare


def _join_rows(left, right, sets, sizes, root, least, percent, links) -> None:
    """Links between rows of ``left`` and ``right`` that ``root`` has in different components."""
    ends = np.unique(np.concatenate([left, right]))
    sketches = _sketches([sets[k] for k in ends])
    filled = (sketches != 0).sum(1)
    place = np.searchsorted(ends, right)
    for i in left:
        n = sizes[right]
        near = np.flatnonzero((root[right] != root[i]) & (100 * np.minimum(n, sizes[i]) >= percent * np.maximum(n, sizes[i])))
        if not len(near):
            continue
        mine = sketches[np.searchsorted(ends, i)]
        bins = np.flatnonzero(mine)
        theirs = sketches[place[near]][:, bins]
        used = filled[place[near]] + len(bins) - (theirs != 0).sum(1)
        alike = (theirs == mine[bins]).sum(1) / used
        # Five standard deviations below what is asked for.
        good = alike >= least - 5 * np.sqrt(least * (1 - least) / used)
        near, alike = near[good], alike[good]
        for j in right[near[np.argsort(-alike, kind="stable")]]:
            if root[j] == root[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                links.append((i, j))
                root[root == root[j]] = root[i]


def _crossing_links(labelled: DataFrame, shared: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components of ``labelled`` (rep, component) which share a bucket."""
    keyed = shared.join(labelled, "rep")
    shares = settle(keyed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")))
    split = shares.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    bonds = shares.join(split, "key").filter("component != main").select(F.col("component").alias("a"), F.col("main").alias("b"))
    areas = components(bonds).select(F.col("id").alias("component"), F.col("component").alias("area"))
    sizes = classes.select("rep", "n_shingles")
    members = keyed.join(split.select("key"), "key", "left_semi").select("rep", "component").distinct()
    members = settle(members.join(sizes, "rep").groupBy("rep", "component").agg(F.sum("n_shingles").alias("size")).join(areas, "component"))

    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("bytes") / TILE_BYTES))
    whole = members.groupBy("area", "component").agg(F.count(F.lit(1)).alias("n"), (F.sum("size") * 8).alias("bytes"))
    whole = whole.groupBy("area").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "component", "bytes")).alias("most"))
    whole = whole.select(
        "area", "main", tiles.alias("tiles"),
        F.ceil(F.greatest(F.col("most.n") / TILE, F.col("most.bytes") / TILE_BYTES)).alias("main_tiles"),
        F.ceil(F.greatest((F.col("n") - F.col("most.n")) / TILE, (F.col("bytes") - F.col("most.bytes")) / TILE_BYTES)).alias("rest_tiles"))
    whole = settle(whole)
    # Small areas share tasks, about a tile's members in each.
    slots = members.count() // TILE + 1
    placed = members.join(whole, "area").withColumn("mine", F.xxhash64("rep"))

    def task(kind: int, slot: Column, i: Column, j: Column, side: int, alone: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), slot.cast("bigint").alias("slot"), i.cast("bigint").alias("i"), j.cast("bigint").alias("j"),
                        F.lit(side).alias("side"), alone.alias("alone"))

    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)
    area, zero = F.col("area"), F.lit(0)
    rest, main = F.pmod("mine", "rest_tiles"), F.pmod("mine", "main_tiles")
    small = F.array(task(0, F.pmod(F.xxhash64("area"), F.lit(slots)), zero, zero, 0, F.lit(True)))
    inside = F.transform(upto(F.col("rest_tiles")), lambda o: F.when(o >= rest, task(1, area, rest, o, 0, o == rest)).otherwise(
        task(1, area, o, rest, 1, F.lit(False))))
    across = F.transform(upto(F.col("main_tiles")), lambda o: task(2, area, rest, o, 0, F.lit(False)))
    mine = F.transform(upto(F.col("rest_tiles")), lambda o: task(2, area, o, main, 1, F.lit(False)))
    tasks = F.when(F.col("tiles") <= 1, small).when(F.col("component") == F.col("main"), mine).otherwise(F.concat(inside, across))
    placed = placed.select("rep", "component", "area", tasks.alias("tasks"))
    spread = placed.join(sets, "rep").select("rep", "component", "area", "shingles", F.explode("tasks").alias("t")).select(
        "rep", "component", "area", "shingles", "t.*")
    return spread.groupBy("kind", "slot", "i", "j").applyInArrow(_tile_links(percent), "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = 5, percent: int = 80, chunks: int = 8,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased; a set
    holds the distinct runs of ``words`` words, or the whole sequence of a shorter text. Documents
    link when ``100 * common >= percent * united``. ``chunks`` sets the signature length: eight
    chunks miss a pair at exactly 0.8 with 2e-5, six at exactly 0.85 with 2e-5, and guarantee every
    pair of signatures with at most ``2 * chunks - 1`` differing components.

    Null and wordless texts have an empty set and link with nothing. Rows of one id are one
    document, whatever their texts. A row without id links with nothing: its component is null and
    it is kept. Equal sets are compared once; an empty table gives an empty result.
    """
    longs = -(-chunks * WIDTH // _LANES)
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(text_col).cast("string").alias("text"))
    rows = settle(texts.mapInArrow(_profiler(words, chunks), _PROFILE))
    linkable = rows.filter("n_shingles > 0 and id is not null")
    classes = settle(linkable.groupBy("d1", "d2").agg(
        F.min("id").alias("rep"), F.min_by("text_hash", "id").alias("rep_hash"),
        F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature")))

    # Stars: each member of a bucket with its smallest; the nearest of these for each member.
    # A representative stands for two sets if its id is repeated; it then has two signatures.
    nodes = classes.select("rep", "signature")
    keyed = nodes.mapInArrow(_indexer(chunks), "key bigint, rep bigint")
    # Most keys belong to one set alone. Only what is left after this is looked at again.
    common = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    shared = settle(keyed.join(common, "key", "left_semi"))
    heads = shared.groupBy("key").agg(F.min("rep").alias("b"))
    stars = shared.join(heads, "key").filter("rep != b").select(F.col("rep").alias("a"), "b").distinct()
    near = _within(stars, nodes, longs, 2 * chunks + chunks // 2)
    first = settle(near.groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b")))
    reps = shared.select("rep").distinct()
    sets = settle(_sets_of(reps, classes, texts, words))
    links = settle(_confirmed(first, sets, percent))

    # What is in one bucket but not yet in one component.
    placed = components(links)
    labelled = reps.join(placed, F.col("rep") == F.col("id"), "left").select("rep", F.coalesce("component", "rep").alias("component"))
    more = settle(_crossing_links(labelled, shared, classes, sets, percent))

    # An id with several texts belongs to the classes of all of them.
    repeated = linkable.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    reps = classes.select("d1", "d2", "rep")
    same = linkable.join(repeated, "id", "left_semi").join(reps, ["d1", "d2"]).select(
        F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(links.union(more).union(same.filter("a != b")))
    found = reps.join(found, F.col("rep") == F.col("id"), "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component"))
    known = rows.filter("n_shingles > 0").join(found, ["d1", "d2"], "left")
    alone = rows.filter("n_shingles = 0").withColumn("component", F.col("id"))
    columns = ["id", "n_shingles", "component"]
    return known.select(*columns).union(alone.select(*columns)).select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _within(pairs: DataFrame, nodes: DataFrame, longs: int, most: int) -> DataFrame:
    """(a, b, distance) of pairs whose signatures differ in at most ``most`` components."""
    one = nodes.select(F.col("rep").alias("a"), F.col("signature").alias("x"))
    two = nodes.select(F.col("rep").alias("b"), F.col("signature").alias("y"))
    # A head's members are joined first, so that adaptive execution can split a head with very many.
    return pairs.join(two, "b").join(one, "a").select(
        "a", "b", _distance("x", "y", longs).alias("distance")).filter(F.col("distance") <= most)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, that with the smallest id; all columns of ``docs``.

    Documents without words or id stay. Of rows that repeat an id one stays.
    """
    # A working name that no column of the caller has.
    name = "_rank"
    while name in docs.columns:
        name += "_"
    result = near_duplicates(docs, id_col, text_col, **options)
    losers = settle(result.filter("not kept and n_shingles > 0").select(id_col).distinct())
    repeated = result.filter("n_shingles > 0").groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    left = docs.join(losers, id_col, "left_anti")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    wordless = F.col(id_col).isNull() | ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return left.withColumn(name, F.row_number().over(order)).filter(
        wordless | (F.col(name) == 1)).select(*docs.columns)
