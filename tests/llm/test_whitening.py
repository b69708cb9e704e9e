"""Whitening against an eigendecomposition of the covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from strandloom.llm import whitening
from strandloom.llm.whitening import fit, whiten

COLUMNS = "vec_id long, embedding array<double>, n string, x int"


def plain(vectors):
    """Distinct whole vectors, their mean, eigenvalues and axes."""
    x = np.unique(np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000, axis=0)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], axes[:, ::-1]


def rows_of(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], COLUMNS).repartition(parts)


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(4)
    return (rnd.normal(size=(700, 20)) * np.linspace(0.3, 4, 20) @ np.linalg.qr(rnd.normal(size=(20, 20)))[0] + 3).tolist()


def test_against_covariance(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = [(k, v) for k, v in enumerate(vectors)] + [(7, vectors[7])] * 300 + [(None, vectors[0]), (900, None), (901, [None, *vectors[0][1:]]), (902, [float("nan"), *vectors[0][1:]]), (903, [float("-inf"), *vectors[0][1:]])]
    df = rows_of(spark, rows, 9)
    out = whiten(df, fit(df)).collect()
    x, values, axes = plain(vectors)
    assert len(out) == 16 * (len(rows) - 4) and {r["n"] for r in out} == {len(x)}
    total = x.sum(axis=0).tolist()
    of = {k: v for k, v in enumerate(vectors)} | {None: vectors[0]}
    signs = {}
    for r in out:
        whole = [math.floor(64 * c) + 1_000_000 for c in of[r["vec_id"]]]
        assert r["deviation"] == sum((len(x) * a - s) ** 2 for a, s in zip(whole, total, strict=True))
        k = r["component"] - 1
        want = (np.array(whole) - x.mean(axis=0)) @ axes[:, k] / math.sqrt(values[k])
        if abs(want) > 1e-3:
            signs.setdefault(k, set()).add(round(r["whitened"] / want, 6))
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-9 and 0 <= r["identity_error"] < 1e-9
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == 16


def test_lengths_ranks_and_single_vectors(spark):
    rows = [(k, [float(k % 5), 2.0 * (k % 5), 1.0]) for k in range(20)] + [(100 + k, [k * 0.5]) for k in range(4)] + [(200, [1.0] * 4), (201, [1.0] * 4), (300, [])]
    df = rows_of(spark, rows)
    out = whiten(df, fit(df)).collect()
    by = {(r["dim"], r["component"]): r for r in out}
    assert sorted(by) == [(1, 1), (3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (4, 3), (4, 4)]
    assert all(by[3, k]["whitened"] is None and by[3, k]["explained"] < 1e-20 for k in (2, 3)) and abs(by[3, 1]["explained"] - 1) < 1e-12
    assert all(by[4, k]["whitened"] is None and by[4, k]["explained"] is None and by[4, k]["identity_error"] is None and by[4, k]["deviation"] == 0 for k in range(1, 5))
    assert {r["n"] for r in out if r["dim"] == 3} == {5} and by[4, 1]["n"] == 1


def test_very_long_components_and_empty_tables(spark):
    df = rows_of(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])])
    out = whiten(df, fit(df)).collect()
    assert len(out) == 6 and all(r["deviation"] is None for r in out if r["vec_id"] < 3) and all(math.isfinite(r["whitened"]) for r in out)
    empty = df.limit(0)
    assert whiten(empty, fit(empty)).collect() == []


def test_small_variances_keep_their_digits(spark):
    """Axes whose variances differ by 14 orders of magnitude; a covariance would lose the small one."""
    rnd = np.random.default_rng(1)
    vectors = [[2.0**28 * a, b / 16] for a, b in rnd.integers(-900, 900, size=(400, 2)).tolist()]
    df = rows_of(spark, list(enumerate(vectors)))
    model = fit(df)[2]
    x, _, _ = plain(vectors)
    off = x - np.round(x.mean(axis=0)).astype(np.int64)
    small = np.var(off[:, 1].astype(float) - off[:, 0] * (np.cov(off[:, 0].astype(float), off[:, 1].astype(float), bias=True)[0, 1] / np.var(off[:, 0].astype(float))))
    assert abs(model.scales[1] ** 2 / small - 1) < 1e-6 and model.identity_error < 1e-4
