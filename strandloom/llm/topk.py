"""Exact top-k inner products by norm buckets.

Vectors become whole numbers, floor(1024 x). They are sorted by length and cut
into buckets; the long vectors come first. Each block of queries first meets FIRST_BUCKETS of the long
buckets, dealt out so that a bucket gets few blocks; the k-th best product there is a query's first
threshold. In every other bucket
the threshold over the two lengths is the least cosine that can still matter.
Above 1 the bucket is skipped; a high cosine prunes by the query's
largest coordinates, each bounding the same coordinate of a candidate; a low
one prunes by length alone. Products of what is left are exact whole
numbers. The buckets that a block can need are the first ones in order of length, so
a block meets them by their rank: an equality join whose keys are spread.

Defined results: null vectors, and those with null or non-finite components,
take no part; vectors meet only others with as many components. Equal scores
go to the smaller id. A query with fewer than k candidates gets all. Rows with
a null id can't be named in a result and take no part. Repeated ids are
candidates as often as they stand in the table; a query is excluded from its
own candidates by id. Empty tables give empty results. Only the id and the
vector are read, so other columns don't matter. Scores are 64-bit: a vector whose squared length in whole
numbers is 2^63 or more (a length of about 2.9 million before scaling) raises an error, since its products need not fit; below, none can overflow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._shared import staged

SCALE = 1024
#: Rows in a bucket and queries in a block: what a task holds at once.
BUCKET_ROWS = 4096
BLOCK_QUERIES = 256
#: From this cosine on, coordinates prune; below, lengths alone.
COORDINATE_COSINE = 0.3
FOCUS = 6
SLACK = 1e-9
#: Buckets that give a block its first thresholds, and blocks that one of them gets, about.
FIRST_BUCKETS = 2
BLOCKS_OF_A_BUCKET = 16

PACKED = "number long, dim int, n int, longest double, shortest double, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, dim, ints (array of long) and norm2 of the rows that take part."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(fine)
    norm2 = F.aggregate(doubles, F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * SCALE).cast("double"), 2.0))
    large = F.lit(float(1 << 63) * (1 - SLACK))
    # floor() ends at the limits of long, whose squares are beyond the bound too.
    checked = F.when(F.col("norm2") < large, F.col("norm2")).otherwise(F.raise_error(F.lit("a vector is too long for 64-bit products")).cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(doubles, lambda x: F.floor(x * SCALE)).alias("ints"), norm2.alias("norm2"))
    return rows.select("id", F.size("ints").alias("dim"), "ints", checked.alias("norm2"))


def _pack(limit: int):
    """Consecutive rows of a partition as blocks of equal dim, numbered by partition."""

    def pack(batches):
        number, held = TaskContext.get().partitionId() << 24, {}

        def block(dim, parts):
            nonlocal number
            ids, vectors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) if dim else np.zeros(len(ids))
            order = np.lexsort((ids, -norms))
            ids, vectors, norms = ids[order], vectors[order], norms[order]
            number += 1
            return [number - 1, dim, len(ids), float(norms[0]), float(norms[-1]), ids.tobytes(), vectors.tobytes()]

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()))],
                names=["number", "dim", "n", "longest", "shortest", "ids", "vectors"],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims, dtype=np.int64)])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                vectors = flat[(starts[at][:, None] + np.arange(dim))].reshape(len(at), dim).astype(np.int64)
                held.setdefault(dim, []).append((ids[at], vectors))
                while sum(len(p[0]) for p in held[dim]) >= limit:
                    a, v = np.concatenate([p[0] for p in held[dim]]), np.concatenate([p[1] for p in held[dim]])
                    yield out([block(dim, [(a[:limit], v[:limit])])])
                    held[dim] = [(a[limit:], v[limit:])]
        rest = [block(dim, parts) for dim, parts in held.items() if sum(len(p[0]) for p in parts)]
        if rest:
            yield out(rest)

    return pack


def _dot(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products: floats where all sums stay below 2^53, whole numbers else."""
    if vectors.size and float(np.abs(vectors).max()) * float(np.abs(q).max()) * len(q) < 2**53:
        return (vectors.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return vectors @ q


def search_bucket(q: np.ndarray, q_norm: float, threshold: float, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and products of the rows of one bucket (longest first) that may reach the threshold."""
    if threshold == -np.inf or threshold <= 0 or not q_norm:
        return ids, _dot(vectors, q)
    if threshold > q_norm * norms[0] * (1 + SLACK):
        return ids[:0], ids[:0]
    reach = int(np.searchsorted(-norms, -(threshold / q_norm) * (1 - SLACK), side="right"))
    cosine = threshold / (q_norm * norms[0])
    at = np.arange(reach)
    if cosine >= COORDINATE_COSINE and reach:
        unit = q / q_norm
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            centre = unit[f] * cosine
            spread = np.sqrt(max(0.0, 1 - unit[f] ** 2) * max(0.0, 1 - min(1.0, cosine) ** 2))
            # A row with a cosine of c or more has this coordinate within the cap of half-angle arccos(c) about the query.
            low = -1.0 if -unit[f] >= cosine else centre - spread
            high = 1.0 if unit[f] >= cosine else centre + spread
            mine = units[at, f]
            at = at[(mine >= low - 1e-7) & (mine <= high + 1e-7)]
            if not len(at):
                break
    return ids[at], _dot(vectors[at], q)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _matcher(k: int):
    def match(batches):
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], []]
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                get = lambda name: cols[name][r].as_py()  # noqa: B023, E731
                dim = get("dim")
                ids, vectors = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("vectors"), np.int64).reshape(get("n"), dim)
                q_ids = np.frombuffer(get("q_ids"), np.int64)
                queries = np.frombuffer(get("q_vectors"), np.int64).reshape(len(q_ids), dim)
                bounds = np.frombuffer(get("bounds"), np.float64)
                norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) if dim else np.zeros(len(ids))
                units = vectors / np.where(norms, norms, 1)[:, None]
                q_norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) if dim else np.zeros(len(q_ids))
                for i in range(len(q_ids)):
                    near, scores = search_bucket(queries[i], float(q_norms[i]), float(bounds[i]), ids, vectors, norms, units)
                    other = near != q_ids[i]
                    near, scores = near[other], scores[other]
                    best = _best(near, scores, k)
                    best = best[scores[best] >= bounds[i]]
                    for to, x in zip(found, (np.full(len(best), q_ids[i]), near[best], scores[best]), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return match


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. What a task has found is cut to k for each query before it moves."""
    by = (F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)


def _with_bounds(batches):
    """Bounds to a block: the k-th best product so far of each query (-inf: none yet), and the least length a bucket must hold."""
    for batch in batches:
        cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        bounds, least = [], []
        for r in range(batch.num_rows):
            ids = np.frombuffer(cols["ids"][r].as_py(), np.int64)
            known = dict(cols["known"][r].as_py() or [])
            values = np.array([float(known.get(i, -np.inf)) for i in ids.tolist()])
            dim = cols["dim"][r].as_py()
            vectors = np.frombuffer(cols["vectors"][r].as_py(), np.int64).reshape(len(ids), dim)
            norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) if dim else np.zeros(len(ids))
            need = np.where((values > 0) & (norms > 0), values / np.where(norms, norms, 1), 0.0)
            bounds.append(values.tobytes())
            least.append(float(need.min()) if len(need) else 0.0)
        keep = ["number", "dim", "ids", "vectors"]
        yield pa.RecordBatch.from_arrays([*(cols[c] for c in keep), pa.array(bounds, pa.binary()), pa.array(least, pa.float64())], names=[*keep, "bounds", "least_need"])


def _members(batches):
    for batch in batches:
        numbers, ids = batch.column(0).to_pylist(), [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(numbers, np.int64), [len(x) for x in ids])), pa.array(np.concatenate(ids) if ids else np.array([], np.int64))], names=["number", "id"])


def _met(grid: DataFrame, blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """What query blocks with bounds find in buckets, for the pairs (q_number, dim, rank) of a grid."""
    q = blocks.select(F.col("number").alias("q_number"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "bounds")
    joined = grid.join(q, "q_number").join(buckets.select("dim", "rank", "n", "ids", "vectors"), ["dim", "rank"])
    return joined.select("dim", "n", "ids", "vectors", "q_ids", "q_vectors", "bounds").mapInArrow(_matcher(k), FOUND)


def first_ranks(block: Column, of_dim: Column, blocks: Column) -> Column:
    """Ranks of the buckets that a block (numbered from 0 within its dim) meets first: among the long ones, FIRST_BUCKETS to a block, BLOCKS_OF_A_BUCKET to a bucket about."""
    wide = F.least(of_dim, F.greatest(F.lit(FIRST_BUCKETS), F.ceil(blocks * FIRST_BUCKETS / BLOCKS_OF_A_BUCKET))).cast("long")
    return F.array_distinct(F.array(*((block * FIRST_BUCKETS + j) % wide for j in range(FIRST_BUCKETS))))


def needed(blocks: DataFrame, buckets: DataFrame) -> DataFrame:
    """q_number, dim and rank of each bucket that is long enough for a block: one cumulative count over both in order of length. One narrow row for each block and bucket."""
    lengths = buckets.select("dim", F.col("longest").alias("length"), F.lit(None).cast("long").alias("q_number"))
    needs = blocks.select("dim", (F.col("least_need") / (1 + SLACK)).alias("length"), F.col("number").alias("q_number"))
    order = Window.partitionBy("dim").orderBy(F.desc("length"), F.col("q_number").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    upto = lengths.unionByName(needs).select("dim", "q_number", F.count(F.when(F.col("q_number").isNull(), 1)).over(order).alias("m")).where("q_number IS NOT NULL AND m > 0")
    return upto.select("q_number", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("rank"))


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k candidates of the largest product for each row for which is_query (a Column over id) holds."""
    rows = staged(quantised(vectors, id_col, vector), "topk-rows")
    count = rows.count()
    parts = max(1, -(-count // (4 * BUCKET_ROWS)))
    order = (F.desc("norm2"), "id")
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    buckets = ordered.select("id", "dim", "ints").mapInArrow(_pack(BUCKET_ROWS), PACKED)
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("longest"), "number")) - 1  # a row for each bucket
    buckets = staged(buckets, "topk-packed")
    ranks = buckets.select("number", rank.cast("long").alias("rank"), F.count("*").over(Window.partitionBy("dim")).alias("of_dim"))
    buckets = staged(buckets.join(ranks, "number"), "topk-buckets")
    queries = rows.where(is_query)
    blocks = queries.repartition(max(1, -(-count // (100 * BLOCK_QUERIES))), "id").select("id", "dim", "ints").mapInArrow(_pack(BLOCK_QUERIES), PACKED)
    blocks = staged(blocks, "topk-queries")
    known = "array<struct<id: long, bound: long>>"
    bounded = "number long, dim int, ids binary, vectors binary, bounds binary, least_need double"
    # First some long buckets of each dim, without bounds.
    of_dim = Window.partitionBy("dim")
    place = blocks.select(F.col("number").alias("q_number"), "dim", (F.row_number().over(of_dim.orderBy("number")) - 1).cast("long").alias("place"), F.count("*").over(of_dim).alias("n_blocks"))
    dims = buckets.groupBy("dim").agg(F.max("of_dim").alias("of_dim"))
    first = place.join(dims, "dim").select("q_number", "dim", F.explode(first_ranks(F.col("place"), F.col("of_dim"), F.col("n_blocks"))).alias("rank"))
    first = staged(first, "topk-first-pairs")
    none = blocks.withColumn("known", F.lit(None).cast(known)).select("number", "dim", "ids", "vectors", "known").mapInArrow(_with_bounds, bounded)
    head = staged(_top(_met(first, none, buckets, k), k), "topk-first")
    kth = head.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    of_block = staged(blocks.select("number", "ids").mapInArrow(_members, "number long, id long"), "topk-members")
    marks = of_block.join(kth, "id").groupBy("number").agg(F.collect_list(F.struct("id", "bound")).alias("known"))  # a block's queries at most
    ready = staged(blocks.join(marks, "number", "left").select("number", "dim", "ids", "vectors", "known").mapInArrow(_with_bounds, bounded), "topk-ready")
    rest = needed(ready, buckets).join(first, ["q_number", "dim", "rank"], "left_anti")
    found = head.select("query_id", "vec_id", "score").unionByName(_met(rest, ready, buckets, k))
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
