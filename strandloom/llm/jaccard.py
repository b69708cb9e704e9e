"""Exact Jaccard join of word shingles with a count-vector R-tree.

A document's set has its distinct shingles (64-bit hashes of SHINGLE words; A-Z
lower-cased). Documents with equal sets are one from here on. Two sets of
Jaccard similarity t or more share k of their first n - ceil(t n) + k shingles
in any common order. With k = n / PREFIX_PARTS, a set of which fewer than
ceil(t n / PREFIX_PARTS) of these shingles are in other sets' has no link (a partner is
not smaller than t n). Sets left are neighbours if they share a shingle that more than
SHORT sets have, or k of the others; a block holds all neighbours of neighbours.
The order puts shingles last that are frequent in a bounded sample of
documents, which only keeps blocks small: any order finds all links.

Within a block the sets are points: shingles are hashed into DIMS groups, and a
point counts its shingles in each. The points are packed into an
R-tree (by size, then by coordinates): leaves of LEAF points, inner nodes of FAN
children, each with its upper corner and its least and greatest size. The sum of coordinate minima bounds an
intersection from above, for points as for upper corners. The tree is joined with itself from the root down: pairs of
nodes, then pairs of points that cannot reach the threshold are left out, and
the intersections of the rest are counted exactly from the sets. Pairs that are connected already are not
counted again, so what a task returns is a forest and not all pairs of a group.

A block of more than CELL_ROWS sets is searched in two steps. First it is cut by size class (sizes that differ by
more than the threshold allows never meet) and hash into tiles, and each tile is
searched alone, together with the block's HUBS sets of least hash, which connect tiles of one family. Then only pairs
from different components are left: sets outside the block's largest component meet each other and that component, in cells of a tile
each. A block that is one family costs one pass over its sets, whatever its size.

Defined results: null texts and texts without words have an empty set, link with
nothing and are their own component. Fewer words than SHINGLE make one shingle. A very long text is one
set in one task's memory, like a row.
Rows are told apart by their number, so rows with a null id, and different texts under one id, take part like others; a null id names no component, and a group of only such
rows has a null component. Repeated rows have equal sets and so one
component. Ties don't matter. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm._shared import drop_staged, fresh, release, small_batches, staged, steady
from strandloom.llm.components import components
from strandloom.llm.substring import _mix, slices, word_hashes, word_table

SHINGLE = 5
#: Similarity in percent.
PERCENT = 80
DIMS = 64
LEAF = 64
FAN = 8
PREFIX_PARTS = 16
#: Lists of at most so many sets are taken pair by pair.
SHORT = 16
CELL_ROWS = 4096
HUBS = 32
#: Documents whose shingles decide which ones are frequent, how many must hold one, and how many are kept.
SAMPLE_DOCS = 8_000
FREQUENT_DOCS = 4
MOST_FREQUENT = 200_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEPS = np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
SETS = "id long, row long, n long, h1 long, h2 long, prefix array<long>"


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted within each text (signed 64-bit hashes), and where each text's begin."""
    gap = b" "
    joined = gap.join(texts) + gap
    raw = _FOLD[np.frombuffer(joined, np.uint8)]
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    starts, ends, docs = word_table(raw, edges)
    counts = np.bincount(docs, minlength=len(texts)) if len(docs) else np.zeros(len(texts), np.int64)
    hashes = word_hashes(raw, starts, ends)
    firsts = np.cumsum(counts) - counts
    parts, owners = [], []
    n = len(hashes) - SHINGLE + 1
    if n > 0:
        whole = np.flatnonzero(docs[:n] == docs[SHINGLE - 1 :])
        acc = np.zeros(len(whole), np.uint64)
        for k in range(SHINGLE):
            acc += _mix(hashes[whole + k] + _STEPS[k])
        parts.append(_mix(acc))
        owners.append(docs[whole])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            there = counts[short] > k
            acc[there] += _mix(hashes[firsts[short][there] + k] + _STEPS[k])
        parts.append(_mix(acc + counts[short].astype(np.uint64)))
        owners.append(short)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    values, owner = np.concatenate(parts).view(np.int64), np.concatenate(owners)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])
    values, owner = values[new], owner[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def prefix_sizes(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set, in the common order, are looked up: two sets of similarity PERCENT share n / PREFIX_PARTS of them, for the smaller n."""
    return n - -(-PERCENT * n // 100) + -(-n // PREFIX_PARTS)


def _sums(values: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(_mix(values.view(np.uint64) ^ np.uint64(salt)), out=total[1:])
    return _mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _describe(frequent: np.ndarray):
    """id, row, set size, set hashes and prefix of each text."""

    def run(batches):
        for batch, texts in slices(batches, 2):
            values, bounds = shingle_sets(texts)
            late = np.zeros(len(values), bool)
            if len(frequent) and len(values):
                at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                late = frequent[at] == values
            owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
            order = np.lexsort((values, late, owner))
            n = np.diff(bounds)
            want = prefix_sizes(n)
            rank = np.arange(len(values)) - bounds[owner]
            chosen = values[order][rank < want[owner]]
            offsets = np.concatenate([[0], np.cumsum(want)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(chosen, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(_sums(values, bounds, 0x51)), pa.array(_sums(values, bounds, 0x7F4A7C15)), prefix], names=["id", "row", "n", "h1", "h2", "prefix"])

    return run


def _all_shingles(batches):
    for _, texts in slices(batches, 0):
        values, _ = shingle_sets(texts)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64())], names=["shingle"])


def frequent_shingles(docs: DataFrame, text: str, count: int) -> np.ndarray:
    """Shingles that many documents of the sample hold, sorted."""
    sample = docs.select(text).sample(False, min(1.0, SAMPLE_DOCS / max(1, count)), seed=11)
    found = sample.mapInArrow(_all_shingles, "shingle long").groupBy("shingle").count().where(F.col("count") >= FREQUENT_DOCS)
    top = found.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).select("shingle").toArrow()
    return np.sort(top.column(0).to_numpy())


def _points(batches):
    """Sets of the texts. Columns: sid, text, cells."""
    for batch, texts in slices(batches, 1):
        values, bounds = shingle_sets(texts)
        raw = values.tobytes()
        blobs = [raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blobs, pa.binary())], names=["sid", "cells", "shingles"])


def count_points(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A row of DIMS group counts for each of n sets, in the narrowest type that holds them."""
    group = (values.view(np.uint64) >> np.uint64(64 - 6)).astype(np.int64)
    counts = np.bincount(owner * DIMS + group, minlength=n * DIMS).reshape(n, DIMS)
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def pack_leaves(sizes: np.ndarray, points: np.ndarray) -> list[np.ndarray]:
    """Leaves of an R-tree by sort-tile packing: slabs by size, runs by the coordinate that spreads most within."""
    order = np.argsort(sizes, kind="stable")
    slab = max(LEAF, int(np.sqrt(len(order) * LEAF)))
    leaves = []
    for low in range(0, len(order), slab):
        part = order[low : low + slab]
        spread = points[part].var(axis=0)
        part = part[np.lexsort((sizes[part], points[part][:, int(spread.argmax())]))]
        leaves += [part[k : k + LEAF] for k in range(0, len(part), LEAF)]
    return leaves


class Tree:
    """An R-tree over points: for each level, from the leaves to the root, the upper corners and the least and greatest sizes of its nodes. Node k has the children FAN k to FAN k + FAN - 1 of the level below."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.leaves = pack_leaves(sizes, points)
        top = np.array([points[leaf].max(axis=0) for leaf in self.leaves])
        least, most = (np.array([f(sizes[leaf]) for leaf in self.leaves]) for f in (np.min, np.max))
        self.levels = [(top, least, most)]
        while len(top) > 1:
            at = np.arange(0, len(top), FAN)
            top, least, most = np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((top, least, most))

    def near_pairs(self) -> tuple[np.ndarray, int]:
        """Pairs of leaves (a <= b, in order) whose points may reach the threshold, by descent from the root paired with itself; and how many pairs of nodes were looked at."""
        pairs, seen = np.zeros((1, 2), np.int64), 0
        for level in range(len(self.levels) - 1, -1, -1):
            top, least, most = self.levels[level]
            kept = []
            for low in range(0, len(pairs), 1 << 14):
                a, b = pairs[low : low + (1 << 14)].T
                seen += len(a)
                sizes_meet = (100 * most[a] >= PERCENT * least[b]) & (100 * most[b] >= PERCENT * least[a])
                a, b = a[sizes_meet], b[sizes_meet]
                kept.append(np.stack([a, b], axis=1)[reaches(np.minimum(top[a], top[b]).sum(axis=1, dtype=np.int64), least[a], least[b])])
            pairs = np.concatenate(kept) if kept else pairs[:0]
            if level:
                below = len(self.levels[level - 1][0])
                step = np.arange(FAN)
                a = np.broadcast_to(FAN * pairs[:, 0, None, None] + step[:, None], (len(pairs), FAN, FAN)).reshape(-1)
                b = np.broadcast_to(FAN * pairs[:, 1, None, None] + step[None, :], (len(pairs), FAN, FAN)).reshape(-1)
                real = (a <= b) & (b < below)
                pairs = np.stack([a[real], b[real]], axis=1)
        return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))], seen


def reaches(bound: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Whether an intersection of this size would do: 100 i >= PERCENT (n1 + n2 - i)."""
    return (100 + PERCENT) * bound >= PERCENT * (n1 + n2)


def link_forest(sids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of similarity PERCENT or more that connect what is connected, found with an R-tree. sides: 0 and 1 mark the two sides of a cell, which are compared with each other only; all 0: one side. groups: what is connected already."""
    m = len(sids)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    points = count_points(values, owner, m)
    # Shingles in numbers; those of one set only can't be in an intersection.
    code, many = np.unique(values, return_inverse=True, return_counts=True)[1:]
    shared = many > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = number[code[keep]], owner[keep]
    bounds = np.searchsorted(owner, np.arange(m + 1))
    width = int(shared.sum())
    # At first a set's root is the first one of its group.
    parent = np.arange(m)
    if groups is not None:
        _, heads, of_set = np.unique(groups, return_index=True, return_inverse=True)
        parent = heads[of_set]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def dense(leaf: np.ndarray, column: np.ndarray | None) -> np.ndarray:
        out = np.zeros((len(leaf), width if column is None else int(column.max(initial=-1)) + 1), np.float32)
        for r, i in enumerate(leaf.tolist()):
            c = code[bounds[i] : bounds[i + 1]]
            if column is not None:
                c = column[c]
                c = c[c >= 0]
            out[r, c] = 1
        return out

    tree = Tree(sizes, points)
    leaves, pairs = tree.leaves, tree.near_pairs()[0]
    links, two_sided, at = [], bool(sides.any()), -1
    for a, b in pairs.tolist():
        first, second = leaves[a], leaves[b]
        if a != at:
            at, mine = a, None
        roots_a, roots_b = np.array([root(i) for i in first.tolist()]), np.array([root(i) for i in second.tolist()])
        open_pairs = roots_a[:, None] != roots_b[None, :]
        if two_sided:
            open_pairs &= sides[first][:, None] != sides[second][None, :]
        if a == b:
            open_pairs &= np.arange(len(first))[:, None] < np.arange(len(second))[None, :]
        n1, n2 = sizes[first][:, None], sizes[second][None, :]
        open_pairs &= (100 * n1 >= PERCENT * n2) & (100 * n2 >= PERCENT * n1)
        if not open_pairs.any():
            continue
        bound = np.minimum(points[first][:, None, :], points[second][None, :, :]).sum(axis=2, dtype=np.int32)
        i, j = np.nonzero(open_pairs & reaches(bound.astype(np.int64), n1, n2))
        if not len(i):
            continue
        if mine is None:  # columns: the shared shingles of the first leaf
            column = np.full(width, -1, np.int64)
            held = np.unique(np.concatenate([code[bounds[x] : bounds[x + 1]] for x in first.tolist()]))
            column[held] = np.arange(len(held))
            mine = dense(first, column)
        other = np.zeros((len(second), mine.shape[1]), np.float32)
        used = np.unique(j)
        got = dense(second[used], column)
        other[used, : got.shape[1]] = got
        both = (mine @ other.T)[i, j].astype(np.int64)
        hit = reaches(both, sizes[first[i]], sizes[second[j]])
        for x, y in zip(first[i[hit]].tolist(), second[j[hit]].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((int(sids[x]), int(sids[y])))
    return links


def _cells(batches):
    """Links of each task's cells; rows (cell, sid, side, group, shingles) come sorted by cell."""
    key, held = None, []

    def links(rows):
        if len(rows) < 2:
            return []
        sids, sides, groups = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        return link_forest(sids, sides, [np.frombuffer(r[3], np.int64) for r in rows], groups)

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for cell, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if cell != key:
                if found := links(held):
                    yield out(found)
                key, held = cell, []
            held.append(row)
    if found := links(held):
        yield out(found)


def linked_in(cells: DataFrame) -> DataFrame:
    """Links a, b within cells: rows (cell, sid, side, group, shingles)."""
    rows = cells.select("cell", "sid", "side", "group", "shingles").repartition("cell").sortWithinPartitions("cell")
    return staged(rows.mapInArrow(_cells, "a long, b long"), "jaccard-links")


def _size_class(n):
    """Sizes that can meet are in one class or in neighbouring ones."""
    return F.floor(F.ln(n.cast("double")) / float(np.log(100 / PERCENT)) + 1e-9).cast("long")


def _tiles(counts, cls):
    """Tiles of half a cell that this many sets of a class make; 0 for a class without any."""
    return F.ceil(F.coalesce(F.try_element_at(counts, cls), F.lit(0)) / (CELL_ROWS // 2)).cast("long")


def _upto(n):
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))


def large_blocks(members: DataFrame) -> DataFrame:
    """block and counts (sets by size class) of the blocks of more than CELL_ROWS sets. members: block, n and others."""
    by_class = members.groupBy("block", _size_class(F.col("n")).alias("class")).agg(F.count("*").alias("m"))
    whole = by_class.groupBy("block").agg(F.sum("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("class", "m"))).alias("counts"))  # some dozens of classes
    return staged(whole.where(F.col("m") > CELL_ROWS).select("block", "counts"), "jaccard-large")


def in_tiles(members: DataFrame, large: DataFrame) -> DataFrame:
    """members (block, sid, n and others) with class (null: all of the block is one cell) and the cells of the first step. Narrow: the sets come later."""
    rows = members.join(large, "block", "left").withColumn("class", F.when(F.col("counts").isNotNull(), _size_class(F.col("n"))))
    cls, counts = F.col("class"), F.col("counts")
    name = lambda c, t: F.concat_ws("/", "block", c, t)
    own = F.array(name(cls, F.pmod(F.xxhash64("sid"), F.greatest(_tiles(counts, cls), F.lit(1)))))
    hub = F.pmod(F.xxhash64(F.lit(1), "sid"), F.lit(1 << 30)) * F.try_element_at(counts, cls) < HUBS * (1 << 30)
    all_of = lambda c: F.transform(_upto(_tiles(counts, c)), lambda k: name(c, k))
    everywhere = F.flatten(F.array(*(all_of(cls + d) for d in (-1, 0, 1))))
    cells = F.when(cls.isNull(), F.array(F.col("block").cast("string"))).when(hub, F.array_union(own, everywhere)).otherwise(own)
    return rows.select(*members.columns, "class", cells.alias("cells"))


def open_cells(rows: DataFrame) -> DataFrame:
    """sid, group, cell and side of the second step, for rows (block, sid, class, group) of large blocks. Sets outside the largest group of their block are tiled, and so are the sets of that group; a cell is two tiles, one of them outside, of classes that can meet."""
    groups = rows.groupBy("block", "group").agg(F.count("*").alias("m"))
    main = groups.groupBy("block").agg(F.max_by("group", F.struct("m", "group")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    apart = staged(rows.join(main.select("block", "main"), "block").select(*rows.columns, (F.col("group") != F.col("main")).alias("out")), "jaccard-apart")
    by_class = apart.groupBy("block", "class").agg(F.count(F.when(F.col("out"), 1)).alias("outs"), F.count(F.when(~F.col("out"), 1)).alias("mains"))
    counts = by_class.groupBy("block").agg(*(F.map_from_entries(F.collect_list(F.struct("class", c))).alias(c) for c in ("outs", "mains")))
    both = apart.join(staged(counts, "jaccard-outside"), "block")
    cls, outs, mains = F.col("class"), F.col("outs"), F.col("mains")
    name = lambda kind, c0, t0, c1, t1: F.concat_ws("/", "block", F.lit(kind), c0, t0, c1, t1)
    mine = lambda counts: F.pmod(F.xxhash64("sid"), F.greatest(_tiles(counts, cls), F.lit(1)))
    cells = lambda counts, c, f: F.transform(_upto(_tiles(counts, c)), f)
    cell = lambda where, side: F.struct(where.alias("cell"), side.cast("int").alias("side"))
    zero, one = F.lit(0), F.lit(1)
    own = mine(outs)
    among = [
        cells(outs, cls, lambda k: cell(name("o", cls, F.least(own, k), cls, F.greatest(own, k)), own > k)),
        cells(outs, cls + 1, lambda k: cell(name("o", cls, own, cls + 1, k), zero)),
        cells(outs, cls - 1, lambda k: cell(name("o", cls - 1, k, cls, own), one)),
    ]
    to_main = lambda c: cells(mains, c, lambda k: cell(name("m", cls, own, c, k), zero))
    from_main = lambda c: cells(outs, c, lambda k: cell(name("m", c, k, cls, mine(mains)), one))
    near = (cls - 1, cls, cls + 1)
    of_row = F.when(F.col("out"), F.flatten(F.array(*among, *map(to_main, near)))).otherwise(F.flatten(F.array(*map(from_main, near))))
    return both.select("sid", "group", F.explode(of_row).alias("c")).select("sid", "group", "c.*")


def several(postings: DataFrame) -> DataFrame:
    """Tokens of two sets or more, with the number and the least of them and a digest of who they are. All is summed within each task before rows move."""
    one, other = F.xxhash64("sid"), F.xxhash64(F.lit(1), "sid")
    ends = postings.groupBy("token").agg(F.count("*").alias("c"), F.min("sid").alias("first"), F.bit_xor(one).alias("x1"), F.bit_xor(other).alias("x2"))
    return ends.where("c > 1")


def neighbours(postings: DataFrame) -> DataFrame:
    """Links a, b that connect all sets that may be similar. postings: token, sid, n.

    Tokens with the same sets are one list with a weight. Sets that share a list of more than SHORT are all linked to its least. Two sets that share
    no such list must share n / PREFIX_PARTS tokens of short ones: their pairs are few for each row, and only those with that weight are links."""
    lists = several(postings).groupBy("c", "x1", "x2", "first").agg(F.min("token").alias("token"), F.count("*").alias("weight"))
    members = staged(postings.join(lists.select("token", "c", "first", "weight"), "token"), "jaccard-members")
    long = members.where((F.col("c") > SHORT) & (F.col("sid") > F.col("first"))).select(F.col("sid").alias("a"), F.col("first").alias("b"))
    rows = members.where(F.col("c") <= SHORT).groupBy("token", "weight").agg(F.array_sort(F.collect_list(F.struct("sid", "n"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, k: F.transform(F.slice("m", k + 2, SHORT), lambda y: F.struct(y["sid"].alias("a"), x["sid"].alias("b"), y["n"].alias("na"), x["n"].alias("nb")))))
    found = rows.select("weight", F.explode(pairs).alias("p")).select("weight", "p.*")
    found = found.where((100 * F.col("na") >= PERCENT * F.col("nb")) & (100 * F.col("nb") >= PERCENT * F.col("na")))
    found = found.groupBy("a", "b", "na", "nb").agg(F.sum("weight").alias("shared")).where(F.col("shared") >= F.ceil(F.least("na", "nb") / PREFIX_PARTS))
    return long.unionByName(found.select("a", "b")).distinct()


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: row (its number, by monotonically_increasing_id over the docs of steady()), id, n, root (of its component; null for an empty set) and least (no_id, id, row: the component's first row by id, nulls last)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, text, docs.count()))
    with small_batches(spark):
        described = staged(rows.mapInArrow(lambda batches: _describe(frequent.value)(batches), SETS), "jaccard-sets")
    # Equal sets are one.
    full = described.where("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    merged = full.groupBy("h1", "h2").agg(first.alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    merged = staged(merged.select("*", F.monotonically_increasing_id().alias("sid")), "jaccard-merged")
    described, wide = staged(described.drop("prefix"), "jaccard-rows"), described
    drop_staged(wide)
    release(spark)
    # Shingles of prefixes that two sets or more have, and the sets that have enough of them.
    postings = merged.select(F.explode("prefix").alias("token"), "sid", "n")
    lists = staged(several(postings).select("token"), "jaccard-lists")
    release(spark)
    shared = staged(postings.join(lists, "token"), "jaccard-shared")
    release(spark)
    enough = F.ceil(F.col("n") * PERCENT / (100 * PREFIX_PARTS))
    able = shared.groupBy("sid", "n").count().where(F.col("count") >= enough).select("sid")
    near = staged(neighbours(staged(shared.join(able, "sid").select("token", "sid", "n"), "jaccard-able")), "jaccard-near")
    drop_staged(shared)
    release(spark)
    block_of = components(near)
    blocks = staged(block_of.select(F.col("node").alias("sid"), F.col("component").alias("block")).unionByName(block_of.select(F.col("component").alias("sid"), F.col("component").alias("block")).distinct()), "jaccard-blocks")
    members = staged(merged.join(blocks, "sid").select("sid", "block", "n", F.col("least.row").alias("row")), "jaccard-block-members")
    large = large_blocks(members)
    wanted = staged(in_tiles(members, large), "jaccard-wanted")
    release(spark)
    # The sets of block members, from the texts of their first rows. Neither side has a bound, so both are sorted.
    texts = rows.select("text", "row").join(wanted.select("row", "sid", "cells").hint("merge"), "row").select("sid", "text", "cells")
    with small_batches(spark):
        sets = staged(texts.mapInArrow(_points, "sid long, cells array<string>, shingles binary"), "jaccard-points", "uncompressed")
    release(spark)
    alone = sets.select(F.explode("cells").alias("cell"), "sid", F.lit(0).alias("side"), F.col("sid").alias("group"), "shingles")
    links = linked_in(alone)
    linked = components(links)
    release(spark)
    # The second step, for pairs of different components of one large block.
    inside = wanted.where("class IS NOT NULL").join(linked, wanted["sid"] == linked["node"], "left").select("block", "sid", "class", F.coalesce("component", "sid").alias("group"))
    open_ = staged(open_cells(inside), "jaccard-open")
    if not open_.isEmpty():
        linked = components(links.unionByName(linked_in(open_.join(sets.select("sid", "shingles"), "sid"))))
    root = F.coalesce("component", "sid")
    named = merged.select("sid", "h1", "h2", "least").join(linked, merged["sid"] == linked["node"], "left").select("h1", "h2", "least", root.alias("root"))
    by_set = named.select("h1", "h2", "root").join(named.groupBy("root").agg(F.min("least").alias("least")), "root")
    return described.join(by_set, ["h1", "h2"], "left").select("row", "id", "n", "root", "least")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles and component_id (the least id reachable by links)."""
    found = similar_rows(steady(docs.select(id_col, text), "jaccard-input"), id_col, text)
    return found.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that a link, or a chain of them, connects to one with a smaller id (then row): of each component one row stays, and every row with an empty set."""
    docs = steady(docs, "jaccard-input")
    found = similar_rows(docs, id_col, text)
    number, gone = fresh(docs, "row_", "gone_")
    out = staged(found.where(F.col("row") != F.col("least.row")).select(F.col("row").alias(gone)), "near-gone")
    left = docs.withColumn(number, F.monotonically_increasing_id())
    return left.join(out, left[number] == out[gone], "left_anti").select(*docs.columns)
