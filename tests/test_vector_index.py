"""The vector index against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from strandloom.operators import vector_index as V
from strandloom.staging import stage


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 16)) * 3
    return [(k, (centres[k % 12 if k % 3 else 0] + rnd.normal(size=16)).tolist()) for k in range(1500)]  # a third on one centre


@pytest.fixture(scope="module")
def frame(spark, rows):
    odd = [(None, rows[0][1]), (9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0, 2.0]), (9005, [None] * 16)]
    return spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(3)


@pytest.fixture(scope="module")
def index(frame):
    return V.build(frame, "id", "v", lists=24)


def exact(rows, queries, k):
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        scores = x @ x[q]
        scores[q] = -np.inf
        out[q] = np.lexsort((np.arange(len(x)), -scores))[:k].tolist()
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_all_lists_are_exact(frame, rows, index):
    assert index.blocks.selectExpr("sum(size(ids)) AS n", "max(size(ids)) AS most").first()[:] == (1500, index.blocks.selectExpr("max(size(ids))").first()[0])
    assert found(index.search(frame.where("id % 30 = 0"), "id", "v", 7, 24)) == exact(rows, range(0, 1500, 30), 7)


def test_tuned_probes_reach_the_recall(frame, rows, index):
    probes, share = index.tune(frame.where("id % 10 = 0"), "id", "v", 10, 0.9)
    assert share >= 0.9 and probes < 24
    queries = frame.where("id % 10 = 1")
    assert V.recall(index.search(queries, "id", "v", 10, probes), index.search(queries, "id", "v", 10, 24)) >= 0.85


def test_crowded_lists_are_many_blocks(spark, frame, rows, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 50)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 4)
    index = V.build(frame, "id", "v", lists=3)
    assert index.blocks.selectExpr("max(size(ids))").first()[0] <= 50 and index.blocks.count() > 29
    assert found(index.search(frame.where("id % 70 = 0"), "id", "v", 5, 3)) == exact(rows, range(0, 1500, 70), 5)


def test_saved_and_empty(spark, frame, index, tmp_path):
    index.save(spark, f"{tmp_path}/saved")
    again = V.load(spark, f"{tmp_path}/saved")
    queries = frame.where("id = 4 OR id > 9000")
    assert found(again.search(queries, "id", "v", 3, 2)) == found(index.search(queries, "id", "v", 3, 2)) and set(found(again.search(queries, "id", "v", 3, 2))) == {4}
    empty = V.build(frame.limit(0), "id", "v")
    assert empty.lists == 0 and empty.search(queries, "id", "v", 3, 1).collect() == []


@pytest.mark.parametrize("probes", [1, 40, 200])
def test_batches_of_probes_are_bounded(probes):
    """A batch's copies for its lists don't grow with the number of lists."""
    rnd = np.random.default_rng(5)
    centroids, x = rnd.normal(size=(200, 16)), rnd.normal(size=(3000, 16)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "vector"])
    made = list(V._nearest_lists(centroids, probes)([batch.slice(0, 1700), batch.slice(1700)]))
    assert max(b.nbytes for b in made) <= 9 << 20
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    wanted = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :probes]
    table = pa.Table.from_batches(made)
    assert np.array_equal(table["id"].to_numpy(), np.repeat(np.arange(3000), probes)) and np.array_equal(table["list"].to_numpy(), wanted.ravel())
    assert np.array_equal(table["rank"].to_numpy(), np.tile(np.arange(probes), 3000)) and table["vector"][-1].as_py() == x[-1].tolist()


def test_no_copies_go_through_the_driver(spark, frame, rows, index):
    """However small the queries are in their file, what is made of them for the lists is never broadcast."""
    queries = stage(frame.where("id % 3 = 0"), "asked")
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = exact(rows, range(0, 1500, 3), 10)
    on = {i: r["list"] for r in index.blocks.select("list", "ids").collect() for i in r["ids"]}
    ranks = np.sort([np.argsort(-(index.centroids @ x[q]), kind="stable").tolist().index(on[i]) for q in near for i in near[q]])
    wanted = int(ranks[math.ceil(0.9 * len(ranks)) - 1]) + 1
    limits = {"spark.sql.maxBroadcastTableSize": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}  # one that is planned raises
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        assert index.tune(queries, "id", "v", 10, 0.9, sample=1 << 30) == (wanted, np.count_nonzero(ranks < wanted) / len(ranks))
        assert found(index.search(queries, "id", "v", 10, 24)) == near
        assert set(found(index.search(queries, "id", "v", 10, wanted))) == set(near)
    finally:
        for name in limits:
            spark.conf.unset(name)


def test_tuning_an_empty_index(frame):
    assert V.build(frame.limit(0), "id", "v").tune(frame, "id", "v", 3) == (0, 1.0)


@pytest.mark.parametrize("most", [1, 500, 1 << 20])
def test_tasks_merge_what_they_find(monkeypatch, most):
    """A task's rows grow with its queries and not with the blocks that they meet; equal scores go to the smaller id, also between blocks."""
    monkeypatch.setattr(V, "HELD_ROWS", most)
    rnd = np.random.default_rng(7)
    q, x = rnd.choice([-1, 1], size=(20, 4)).astype(np.float32), rnd.choice([-1, 1], size=(2000, 4)).astype(np.float32)  # many ties, all products exact
    blocks = [np.arange(n, n + 50) for n in range(0, 2000, 50)][::-1]
    columns = [pa.array([list(range(20))] * 40, pa.list_(pa.int64())), pa.array([q.ravel()] * 40, pa.list_(pa.float32())), pa.array([list(b) for b in blocks], pa.list_(pa.int64())), pa.array([x[b].ravel() for b in blocks], pa.list_(pa.float32())), pa.array([int(b[0]) // 50 for b in blocks], pa.int32())]
    batch = pa.RecordBatch.from_arrays(columns, names=["query_ids", "query_vectors", "ids", "vectors", "list"])
    made = pa.Table.from_batches(V._best(6)([batch.slice(0, 13), batch.slice(13)])).to_pylist()
    assert most < 1 << 20 or len(made) == 120
    scores = q.astype(np.float64) @ x.astype(np.float64).T / 4
    scores[np.arange(20), np.arange(20)] = -np.inf
    for n in range(20):
        best = sorted(((-r["similarity"], r["id"]) for r in made if r["query_id"] == n))[:6]
        assert [i for _, i in best] == np.lexsort((np.arange(2000), -scores[n]))[:6].tolist()
    assert all(r["list"] == r["id"] // 50 for r in made)


@pytest.mark.parametrize("most", [1, 3000, 8 << 20])
def test_ranks_of_lists_in_slices(monkeypatch, most):
    monkeypatch.setattr(V, "SLICE_BYTES", most)
    rnd = np.random.default_rng(11)
    centroids, x = rnd.normal(size=(30, 8)), rnd.normal(size=(50, 8)).astype(np.float32)
    exact = [[{"id": 100 * q + n, "list": int(at)} for n, at in enumerate(rnd.integers(0, 30, size=q % 4))] for q in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(list(x), pa.list_(pa.float32())), pa.array(exact, pa.list_(pa.struct([("id", pa.int64()), ("list", pa.int32())])))], names=["query_id", "vector", "exact"])
    order = np.argsort(-(x.astype(np.float64) @ centroids.T), axis=1).tolist()
    wanted = [(q, e["id"], order[q].index(e["list"])) for q in range(50) for e in exact[q]]
    assert [tuple(r.values()) for r in pa.Table.from_batches(V._ranks(centroids)([batch.slice(0, 21), batch.slice(21)])).to_pylist()] == wanted
