"""Whitening of embeddings by a tall-and-skinny QR decomposition.

Components become whole numbers, floor(64 x) + 1000000. Each different vector counts once in the fit: exact sums give the
mean, rows are centred by it, each task reduces its rows to one triangular factor (block by block, so it holds one block), factors
meet in a tree of FAN_IN at a time, and the singular values and right vectors of the last factor are the scales and
axes. No covariance is formed, so small variances keep their digits. Sums and the check of the result take the same tree. What the
driver gets is one factor and one row of sums for each length of vector.

Defined results: vectors that are null or hold null or non-finite components are dropped; vectors of
each length are fitted by themselves, and an empty vector has no components and no rows. Rows with a null id, and repeated
rows, are returned like others. Components are those of the MOST largest eigenvalues; equal eigenvalues come in any order of axes, with one sign for
all rows. An axis without variance (an eigenvalue below the rounding of the largest) has a null in whitened; explained is null if nothing varies at all;
identity_error is taken over the axes with variance, null without any. Scaled components beyond 2^50 count as 2^50. deviation is exact; null where it needs more than 63 bits.
An empty table gives an empty result. Only the id and the vector are read, whatever other columns there are.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm._shared import fresh, staged

SCALE, SHIFT = 64, 1_000_000
MOST = 16
FAN_IN = 16
BLOCK_ROWS = 4096
BOUND = 1 << 50

STATE = "dim int, node long, state binary"
WHITENED = "dim int, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Model:
    """The whitening of vectors of one length. The mean is base + rest / n."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    axes: np.ndarray  # a column for each component, unit length
    scales: np.ndarray  # square roots of eigenvalues; 0 where nothing varies
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.centred(x) @ self.axes) / self.scales

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact."""
        off = x - self.base
        most = int(np.abs(off).max(initial=0)) + 1
        if (self.n * most) ** 2 * max(1, x.shape[1]) < 1 << 62:
            return ((self.n * off - self.rest) ** 2).sum(axis=1).tolist()
        rest = self.rest.tolist()
        whole = (sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in off.tolist())
        return [v if v < 1 << 63 else None for v in whole]


def whole_vectors(df: DataFrame, vector: str) -> DataFrame:
    """df's rows that take part, with a column x (array of long) in place of the vector; other columns stay."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    bounded = lambda v: F.greatest(F.least(F.floor(v.cast("double") * SCALE), F.lit(BOUND)), F.lit(-BOUND)) + SHIFT
    rows = df.where(F.col(vector).isNotNull()).where(fine)
    return rows.select(*[c for c in df.columns if c != vector], F.transform(vector, bounded).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places in the batch and matrix of the vectors of each length, by BLOCK_ROWS rows at most."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK_ROWS):
            column = batch.column(at).slice(low, BLOCK_ROWS)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes, dtype=np.int64) - sizes
            for dim in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == dim)
                yield dim, low + rows, flat[starts[rows][:, None] + np.arange(dim)]


def _reduced(df: DataFrame, start: Callable, add: Callable, merge: Callable, finish: Callable = lambda s: s) -> dict[int, object]:
    """A state for each length of vector, from those of all tasks, FAN_IN at a time. start(dim), add(state, matrix) and merge(states) make states; finish() takes one before it is sent."""

    def of_task(batches):
        states: dict[int, object] = {}
        for dim, _, block in _blocks(batches, 0):
            states[dim] = add(states[dim] if dim in states else start(dim), block)
        if states:
            node = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(states, pa.int32()), pa.array([node] * len(states), pa.int64()), pa.array([pickle.dumps(finish(s)) for s in states.values()], pa.binary())], names=["dim", "node", "state"])

    def of_nodes(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "node": [key[1]], "state": [pickle.dumps(merge(list(map(pickle.loads, frame["state"]))))]})

    level, tasks = df.mapInArrow(of_task, STATE), df.rdd.getNumPartitions()
    while tasks > 1:
        level = level.select("dim", (F.col("node") / FAN_IN).cast("long").alias("node"), "state").groupBy("dim", "node").applyInPandas(of_nodes, STATE)
        tasks = math.ceil(tasks / FAN_IN)
    return {row["dim"]: pickle.loads(row["state"]) for row in level.collect()}


def _sums(state: tuple[int, list[int]], block: np.ndarray) -> tuple[int, list[int]]:
    # BLOCK_ROWS numbers below 2^51 fit 64 bits; the sums of blocks are Python's.
    return state[0] + len(block), [a + b for a, b in zip(state[1], block.sum(axis=0).tolist(), strict=True)]


def _factor(*parts: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.concatenate(parts), mode="r")


def _moments(parts: list[tuple]) -> tuple:
    """(n, mean, sum of centred products) of all parts."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def fit(df: DataFrame, vector: str = "embedding", most: int = MOST) -> dict[int, Model]:
    """A model for each length of the vectors of df."""
    distinct = staged(whole_vectors(df.select(vector), vector).distinct(), "vectors")
    models: dict[int, Model] = {}
    sums = _reduced(distinct, lambda dim: (0, [0] * dim), _sums, lambda parts: (sum(p[0] for p in parts), [sum(v) for v in zip(*(p[1] for p in parts), strict=True)]))
    for dim, (n, total) in sums.items():
        base = [s // n for s in total]
        rest = [s - b * n for s, b in zip(total, base, strict=True)]
        models[dim] = Model(n, np.array(base, np.int64), np.array(rest, np.int64), np.zeros((dim, 0)), np.zeros(0), np.zeros(0))
    factors = _reduced(distinct, lambda dim: np.zeros((0, dim)), lambda r, block: _factor(r, models[block.shape[1]].centred(block)), lambda parts: _factor(*parts))
    for dim, factor in factors.items():
        model = models[dim]
        _, values, right = np.linalg.svd(factor, full_matrices=True)
        values = np.concatenate([values, np.zeros(dim - len(values))])
        # Every entry of a row is rounded once when it is centred, to a share of 2^-53.
        varies = values > values[0] * max(dim, 64) * 2.0**-52
        count, trace = min(dim, most), float((values**2).sum())
        model.axes = np.ascontiguousarray(right.T[:, :count])
        model.scales = np.where(varies, values, 0.0)[:count] / math.sqrt(model.n)
        model.explained = values[:count] ** 2 / trace if trace else np.full(count, np.nan)

    def moments(state, block):
        model = models[block.shape[1]]
        w = model.whiten(block)[:, model.scales > 0]
        mean = w.mean(axis=0)
        part = (len(w), mean, (w - mean).T @ (w - mean))
        return _moments([state, part]) if state is not None else part

    for dim, (n, _, products) in _reduced(distinct, lambda dim: None, moments, _moments).items():
        if products.size:
            models[dim].identity_error = float(np.abs(products / n - np.eye(len(products))).max())
    return models


def whiten(df: DataFrame, models: dict[int, Model], id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The id and the columns of WHITENED for each row that takes part and each component."""
    id_type = df.schema[id_col].dataType
    (name,) = fresh(df.select(id_col), "x")
    rows = whole_vectors(df.select(id_col, vector), vector).withColumnRenamed("x", name)

    def run(batches):
        for batch in batches:
            for dim, at, x in _blocks(iter([batch]), 1):
                model = models[dim]
                count = len(model.scales)
                w = model.whiten(x).ravel()
                flat = lambda values: np.tile(values, len(x))
                nulls = flat(model.scales == 0)
                explained = flat(model.explained)
                columns = [
                    batch.column(0).take(pa.array(np.repeat(at, count))),
                    pa.array(np.full(len(w), dim, np.int32)),
                    pa.array(flat(np.arange(1, count + 1, dtype=np.int32))),
                    pa.array(np.full(len(w), model.n, np.int64)),
                    pa.array([d for d in model.deviation(x) for _ in range(count)], pa.int64()),
                    pa.array(w, mask=nulls),
                    pa.array(explained, mask=np.isnan(explained)),
                    pa.array([model.identity_error] * len(w), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *WHITENED_NAMES])

    return rows.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, {WHITENED}")


WHITENED_NAMES = [part.split()[0] for part in WHITENED.split(", ")]
