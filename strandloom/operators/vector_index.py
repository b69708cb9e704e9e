"""An index for nearest neighbours by cosine: inverted lists behind coarse centroids.

Centroids are fitted by k-means on a bounded sample, round by round: tasks sum the vectors nearest to each centroid, and only the sums meet. Every row is
then put on the list of its nearest centroid; lists are stored as blocks of at most BLOCK_ROWS vectors, ranged by list and id, so a list that holds a third
of all rows is many blocks. A search asks the `probes` nearest lists of each query: blocks of queries meet blocks of their lists by an equality join, each pair
is one matrix product with its own best k, and the best of these are left. Scores are exact; what can be missed is a
neighbour on a list that was not asked. With as many probes as lists nothing is: blocks are then dealt into a fixed number of parts, and each part gets the queries
once. `tune` finds the least number of probes that reaches a recall.

Spark's estimates don't know that queries are copied for the lists they ask, and adaptive execution doesn't take a broadcast back. So these joins are merge joins by a hint: no copies go through the driver.

Rows with a null id, and vectors that are null, of length zero, with null or non-finite components, or with another number of components than the centroids, are not in the index, and queries like
that have no results. Equal scores go to the smaller id. A query's own id is not its neighbour.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.staging import new_place, stage

#: Rows that centroids are fitted on, rounds of the fit, and the most lists: bounds of the model.
FIT_ROWS, FIT_ROUNDS, MOST_LISTS = 20_000, 8, 4096
BLOCK_ROWS, BLOCK_QUERIES = 1024, 256
#: Neighbours that a task holds before it merges them.
HELD_ROWS = 1 << 20
#: Parts for each core that blocks are dealt into where queries meet all of them.
CORE_PARTS = 3
#: Bytes of a task's products with the centroids, and of the rows that it makes of them, at once.
SLICE_BYTES = 8 << 20

_BLOCK = "list int, ids array<long>, vectors array<float>"
_FOUND = "query_id long, id long, similarity double, list int"


def usable(df: DataFrame, key: str, vector: str, dim: int | None = None) -> DataFrame:
    """id and vector (array of float) of the rows that can have a cosine."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull() & v.isNotNull()).where(fine)
    rows = rows if dim is None else rows.where(F.size(v) == dim)
    return rows.select(F.col(key).cast("long").alias("id"), v.cast("array<float>").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def fit_centroids(rows: DataFrame, lists: int, rounds: int = FIT_ROUNDS, sample: int = FIT_ROWS) -> np.ndarray:
    """Centroids of unit vectors, from the rows of the sample (the first by a hash of their id)."""
    some = rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample)
    taken = stage(some.repartition(max(1, min(rows.sparkSession.sparkContext.defaultParallelism, sample // 1000))), "index-sample")
    first = taken.orderBy("h", "id").limit(lists).select("vector").collect()  # so many rows as centroids
    if not first:
        return np.zeros((0, 0))
    centroids = np.array([r["vector"] for r in first], np.float64)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    for _ in range(rounds):
        held = centroids

        def sums(batches, held=held):
            for batch in batches:
                x = _matrix(batch.column(0))
                at = np.argmax(x @ held.T, axis=1)
                near = np.unique(at)
                out = np.zeros((len(held), x.shape[1]))
                np.add.at(out, at, x)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(list(out[near]), pa.list_(pa.float64()))], names=["list", "total"])

        parts = taken.select("vector").mapInArrow(sums, "list int, total array<double>")
        places = parts.select("list", F.posexplode("total")).groupBy("list", "pos").agg(F.sum("col").alias("s"))
        new = centroids.copy()
        met = places.toArrow()  # one number for each component of each centroid
        new[met["list"].to_numpy(), met["pos"].to_numpy()] = met["s"].to_numpy()
        norms = np.linalg.norm(new, axis=1, keepdims=True)
        centroids = np.where(norms > 0, new / np.where(norms > 0, norms, 1), centroids)
    return centroids


def _nearest_lists(centroids: np.ndarray, probes: int):
    """Rows of id, vector and list, by the rank of the list: the nearest ones of each vector. Batches are taken in slices, as each of their rows becomes so many as there are probes."""
    probes = min(probes, len(centroids))
    step = max(1, SLICE_BYTES // (16 * len(centroids) + probes * (16 + 4 * centroids.shape[1])))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                order = np.argsort(-(_matrix(batch.column(1)) @ centroids.T), axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(len(order)), probes))
                columns = [batch.column(c).take(rows) for c in range(2)] + [pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(probes, dtype=np.int32), len(order)))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "list", "rank"])

    return run


def _ranks(centroids: np.ndarray):
    """query_id, id and rank of rows of query_id, vector and exact (structs of id and list): where each id's list comes in the query's order of lists."""
    step = max(1, SLICE_BYTES // (24 * len(centroids)))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                order = np.argsort(-(_matrix(batch.column(1)) @ centroids.T), axis=1, kind="stable")
                places = np.empty_like(order)
                np.put_along_axis(places, order, np.arange(len(centroids))[None, :], axis=1)
                exact = batch.column(2)
                rows, flat = np.repeat(np.arange(len(order)), exact.value_lengths().to_numpy()), exact.flatten()
                ranks = places[rows, flat.field("list").to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), flat.field("id"), pa.array(ranks.astype(np.int32))], names=["query_id", "id", "rank"])

    return run


def _blocked(rows: DataFrame, most: int) -> DataFrame:
    """Rows of id, vector and list as blocks of one list, of so many rows at most."""

    def run(batches):
        now, ids, vectors = None, [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(vectors)], pa.list_(pa.float32()))], names=["list", "ids", "vectors"])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for key, vector, where in zip(batch.column(0).to_pylist(), flat, batch.column(2).to_pylist(), strict=True):
                if ids and (where != now or len(ids) == most):
                    yield block()
                    ids, vectors = [], []
                now = where
                ids.append(key)
                vectors.append(vector.astype(np.float32))
        if ids:
            yield block()

    return rows.select("id", "vector", "list").repartitionByRange("list", "id").sortWithinPartitions("list", "id").mapInArrow(run, _BLOCK)


@dataclass
class VectorIndex:
    centroids: np.ndarray
    blocks: DataFrame

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int) -> DataFrame:
        """query_id, rank (from 1), id and similarity: the k nearest on the probed lists."""
        if not self.lists:
            return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, similarity double")
        return self._found(queries, key, vector, k, probes).select("query_id", "rank", "id", "similarity")

    def _found(self, queries: DataFrame, key: str, vector: str, k: int, probes: int) -> DataFrame:
        """The columns of search, and the list that a row was found on."""
        asked, names = usable(queries, key, vector, self.centroids.shape[1]), {"ids": "query_ids", "vectors": "query_vectors"}
        if probes < self.lists:
            asked = asked.mapInArrow(_nearest_lists(self.centroids, probes), "id long, vector array<float>, list int, rank int")
            pairs = self.blocks.join(_blocked(asked, BLOCK_QUERIES).withColumnsRenamed(names).hint("merge"), "list")
        else:
            parts = CORE_PARTS * queries.sparkSession.sparkContext.defaultParallelism
            of = _blocked(asked.withColumn("list", F.lit(0)), BLOCK_QUERIES).drop("list").withColumnsRenamed(names)
            of = of.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            pairs = self.blocks.withColumn("part", F.pmod(F.hash("list", "ids"), F.lit(parts))).join(of.hint("merge"), "part")
        found = pairs.select("query_ids", "query_vectors", "ids", "vectors", "list").mapInArrow(_best(k), _FOUND)
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def tune(self, queries: DataFrame, key: str, vector: str, k: int, recall: float = 0.9, sample: int = 200) -> tuple[int, float]:
        """The least number of probes whose recall on a sample of the queries reaches the wanted one, and that recall. Measured against exact results: where each exact neighbour's list comes in the query's order of lists."""
        if not self.lists:
            return 0, 1.0
        some = queries.select(key, vector).withColumn("h_", F.xxhash64(key)).orderBy("h_", key).limit(sample).drop("h_")
        some = stage(some.repartition(queries.sparkSession.sparkContext.defaultParallelism), "tuned-on")  # a limit leaves one partition
        exact = stage(self._found(some, key, vector, k, self.lists).select("query_id", "id", "list"), "exact")
        of = exact.groupBy("query_id").agg(F.collect_list(F.struct("id", "list")).alias("exact"))  # k of a query at most
        asked = usable(some, key, vector, self.centroids.shape[1]).join(of.hint("merge"), F.col("id") == F.col("query_id"))
        ranks = asked.select("query_id", "vector", "exact").mapInArrow(_ranks(self.centroids), "query_id long, id long, rank int")
        least = ranks.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
        hits = least.groupBy("rank").agg(F.count("*").alias("n")).orderBy("rank").collect()  # a row for each list at most
        total, seen = sum(r["n"] for r in hits), 0
        for r in hits:
            seen += r["n"]
            if seen >= recall * total:
                return r["rank"] + 1, seen / total
        return self.lists, 1.0

    def save(self, spark: SparkSession, folder: str) -> None:
        rows = [(n, list(map(float, c))) for n, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
        self.blocks.write.parquet(f"{folder}/blocks")


def _best(k: int):
    """The k nearest of each query of a block in a block of rows; a task merges what it finds, and holds HELD_ROWS or a block's at most."""

    def merged(held):
        query_ids, ids, scores, lists = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((ids, -scores, query_ids))
        of = query_ids[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        kept = order[np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)])) < k]
        return query_ids[kept], ids[kept], scores[kept], lists[kept]

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for query_ids, q, ids, x, at in zip(*(batch.column(c) for c in range(5)), strict=True):
                query_ids, ids = query_ids.values.to_numpy(), ids.values.to_numpy()
                unit = lambda v, n: (m := v.values.to_numpy().astype(np.float64).reshape(n, -1)) / np.linalg.norm(m, axis=1, keepdims=True)
                scores = unit(q, len(query_ids)) @ unit(x, len(ids)).T
                scores[(query_ids[:, None] == ids[None, :]) | ~np.isfinite(scores)] = -np.inf
                # All that reach the k-th score, so that merging gives ties to the smaller id.
                least = np.partition(scores, -k, axis=1)[:, -k, None] if len(ids) > k else -np.inf
                rows, columns = np.nonzero((scores >= least) & (scores > -np.inf))
                held.append((query_ids[rows], ids[columns], scores[rows, columns], np.full(len(rows), at.as_py(), np.int32)))
                n += len(rows)
                if n >= HELD_ROWS:
                    held = [merged(held)]
                    if (n := len(held[0][0])) > HELD_ROWS // 2:
                        yield _found_batch(held[0])
                        held, n = [], 0
        if n:
            yield _found_batch(merged(held))

    return run


def _found_batch(columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "similarity", "list"])


def build(df: DataFrame, key: str, vector: str, lists: int | None = None, folder: str | None = None) -> VectorIndex:
    """An index over all rows of df, kept in a folder (one of its own if none is given). lists: about the square root of the number of rows unless given."""
    spark, folder = df.sparkSession, folder or new_place(df.sparkSession, "vector-index")
    rows = usable(df, key, vector)
    shape = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return VectorIndex(np.zeros((0, 0)), spark.createDataFrame([], _BLOCK))
    rows = rows.where(F.size("vector") == shape["dim"])  # the most frequent length
    count = max(1, min(lists or math.isqrt(shape["n"]), MOST_LISTS, FIT_ROWS, shape["n"]))
    centroids = fit_centroids(rows, count)
    placed = rows.mapInArrow(_nearest_lists(centroids, 1), "id long, vector array<float>, list int, rank int")
    VectorIndex(centroids, _blocked(placed, BLOCK_ROWS)).save(spark, folder)
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> VectorIndex:
    rows = spark.read.schema("list int, centroid array<double>").parquet(f"{folder}/centroids").orderBy("list").collect()
    return VectorIndex(np.array([r["centroid"] for r in rows]), spark.read.schema(_BLOCK).parquet(f"{folder}/blocks"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    hits = found.select("query_id", "id", F.lit(1).alias("hit")).distinct().hint("merge")
    both = exact.select("query_id", "id").distinct().join(hits, ["query_id", "id"], "left")
    row = both.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0
