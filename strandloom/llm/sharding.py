"""Uniform shuffle into shards of exact sizes through a communication matrix.

Each shard is cut into blocks of bounded size. The number of rows that an
input partition sends to each block is drawn from the multivariate
hypergeometric law, so all row counts are exact before a row moves. A
splitting tree over the input partitions draws the matrix: every task walks
from the root to its own leaf with random numbers seeded by the tree node, so
no task and not the driver holds more than one row of the matrix. A task deals
its rows out by a random permutation, the rows are exchanged once, and each
block is put into random order. Places in a shard follow from the block sizes,
so no task ever sees a whole shard, and how many bytes one puts into order does not grow with the input.

Defined results: shard sizes differ by one at most; nulls, empty and very long texts and
repeated rows are rows like others, and equal texts are dealt apart from each other like any two rows; an empty table gives an empty table. Input
columns named like an output column are replaced by it. The same input
partitions and seed give the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm._shared import fresh, steady

#: numpy's own sampler takes populations below this.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among draws without replacement; past numpy's limit by inversion outward from the mode."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - at_mode
    down, up, p_down, p_up = mode, mode, at_mode, at_mode
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up < 1e-18 and p_down < 1e-18:
            break
    return mode


def multivariate(rng: np.random.Generator, sizes: np.ndarray, draws: int) -> np.ndarray:
    """How many of each kind are among draws from kinds of these sizes."""
    total = int(sizes.sum())
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(sizes, draws, method="marginals")
    out = np.zeros_like(sizes)
    for k, size in enumerate(sizes.tolist()):
        if not draws:
            break
        out[k] = hypergeometric(rng, size, total - size, draws)
        total, draws = total - size, draws - int(out[k])
    return out


def matrix_row(counts: list[int], sizes: np.ndarray, seed: int, at: int) -> np.ndarray:
    """Rows that input partition number at sends to each block, by the tree over all partitions."""
    before = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    low, high, here = 0, len(counts), sizes.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = multivariate(np.random.default_rng([seed, low, high]), here, int(before[middle] - before[low]))
        if at < middle:
            high, here = middle, left
        else:
            low, here = middle, here - left
    return here


def block_sizes(rows: int, shards: int, per_block: int) -> tuple[int, np.ndarray]:
    """Blocks in each shard, and the sizes of all blocks in order."""
    of_shard = [rows // shards + (s < rows % shards) for s in range(shards)]
    k = max(1, -(-max(of_shard) // per_block))
    return k, np.array([n // k + (j < n % k) for n in of_shard for j in range(k)], dtype=np.int64)


def shard(df: DataFrame, n_shards: int, seed: int = 20240229, block_rows: int = 4096) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard). block_rows bounds what is put into order at once."""
    df = df.select(*[c for c in df.columns if c.lower() not in ("shard", "slot")])
    df = steady(df, "shard-input")  # partitions must hold the same rows in both jobs below
    found = {r[0]: r[1] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()}  # a row for each partition
    counts = [found.get(p, 0) for p in range(max(found, default=-1) + 1)]
    k, sizes = block_sizes(sum(counts), n_shards, block_rows)
    block, key, origin = fresh(df, "block_", "key_", "origin_")
    out = T.StructType([*df.schema, T.StructField(block, T.LongType()), T.StructField(key, T.LongType()), T.StructField(origin, T.LongType())])

    def deal(batches):
        at = TaskContext.get().partitionId()
        expected = counts[at] if at < len(counts) else 0
        rng, done, targets = np.random.default_rng([seed, 1, at]), 0, None
        for batch in batches:
            if targets is None:
                if not expected:
                    raise RuntimeError(f"partition {at} holds rows that the count did not see")
                targets = rng.permutation(np.repeat(np.arange(len(sizes)), matrix_row(counts, sizes, seed, at)))
            n = batch.num_rows
            if done + n > expected:
                raise RuntimeError(f"partition {at} holds more rows than the {expected} counted")
            extra = [targets[done : done + n], rng.integers(-(2**63), 2**63 - 1, n), np.arange(done, done + n) + (at << 40)]
            done += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in extra)], names=[*batch.schema.names, block, key, origin])
        if done != expected:
            raise RuntimeError(f"partition {at} holds {done} rows, not the {expected} counted")

    dealt = df.mapInArrow(deal, out)
    place = F.row_number().over(Window.partitionBy(block).orderBy(key, origin))
    rows, number, within = sum(counts), F.col(block), F.col(block) % k
    of_shard = F.lit(rows // n_shards) + F.when(F.floor(number / k) < rows % n_shards, 1).otherwise(0)
    start = within * F.floor(of_shard / k) + F.least(within, of_shard % k)
    return dealt.select(
        *df.columns,
        F.floor(number / k).cast("int").alias("shard"),
        (start + place - 1).cast("long").alias("slot"),
    )
