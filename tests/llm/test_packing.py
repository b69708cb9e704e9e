"""Packing: properties on whole tables, best fit against a plain version, and the distributed path at its defaults."""

from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import packing
from strandloom.llm._shared import staged
from strandloom.llm.tokens import tokenizer_path

TEXTS = [None, "", "  \n ", "a", *["one text that stands often"] * 40, "x y " * 900, *(" ".join(f"w{k}" for k in range(n)) for n in range(1, 60, 3))]


def check_places(rows, capacity):
    """Sequences are gapless from 0 and no longer than the capacity; returns how many there are."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by_seq)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 9 else None, t) for k, t in enumerate(TEXTS)] + [(1, "one text that stands often")] * 5
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("SEQUENCE_ID", F.lit("mine")).repartition(3)


@pytest.mark.parametrize("runs", [2, 512])
def test_documents(spark, docs, monkeypatch, runs):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SWEEP_RUNS", runs)
    monkeypatch.setattr(packing, "ORDER_ROWS", 10)
    monkeypatch.setattr(packing, "BLOCK", 4)
    found = packing.pack_documents(docs, 64).collect()
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    whole = Counter((r["doc_id"], np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs.collect())
    pieces = Counter((i, ids[a : a + 256]) for (i, ids), n in whole.items() for a in range(0, len(ids), 256) for _ in range(n))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in found) == pieces
    for r in found:
        assert r["start"] == 64 * r["piece"] and len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    assert check_places(found, 64) <= 1.02 * -(-sum(r["length"] for r in found) // 64) + 1
    assert packing.pack_documents(docs.limit(0), 64).count() == 0
    assert packing.pack_documents(docs, 64, with_ids=False).where("ids IS NOT NULL").count() == 0


def plain_best_fit(sizes, capacity):
    """Sequences that best fit fills, one piece after another."""
    gaps, n = [], 0
    for size in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, size)
        if k == len(gaps):
            n += 1
            left = capacity - size
        else:
            left = gaps.pop(k) - size
        bisect.insort(gaps, left)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_sweep_is_best_fit(seed):
    rng = random.Random(seed)
    sizes = [min(100, int(rng.lognormvariate(2.5, 1)) + 1) for _ in range(400)] + [rng.randrange(1, 60)] * rng.randrange(300)
    runs, at = [], 0
    for size, n in sorted(Counter(sizes).items(), reverse=True):
        runs.append((packing.PIECE, size, at, n))
        at += n
    matches, pieces, _ = packing.sweep(runs, 100, 0)
    assert not pieces and sum(m[1] for m in matches) == len(sizes)
    filled = Counter()
    for _, n, per, seq, offset, size in matches:
        for k in range(n):
            assert filled[seq + k // per] == offset + k % per * size
            filled[seq + k // per] += size
    assert max(filled.values()) <= 100 and len(filled) == plain_best_fit(sizes, 100)


def test_runs_cost_one_step():
    matches, _, _ = packing.sweep([(packing.PIECE, 300, 0, 10**12), (packing.PIECE, 7, 10**12, 10**9)], 4096, 0)
    assert len(matches) < 12


def test_left_over_runs():
    matches, pieces, gaps = packing.sweep([(packing.PIECE, 9, 0, 4), (packing.GAP, 8, 50, 2), (packing.PIECE, 5, 4, 3)], 10)
    assert matches == [(4, 2, 1, 50, 2, 5)] and pieces == [(9, 0, 4), (5, 6, 1)] and gaps == [(3, 50, 2)]


def test_ranges_at_defaults(spark):
    """More lengths than a task sweeps: several rounds, several ranges."""
    rng = np.random.default_rng(1)
    sizes = np.minimum(4096, rng.lognormal(6, 1.2, 60_000).astype(int) + 1)
    assert len(set(sizes.tolist())) > 2 * packing.SWEEP_RUNS
    pieces = staged(spark.createDataFrame([(k, int(s)) for k, s in enumerate(sizes)], "row long, length int"), "test-pieces")
    found = packing.pack(pieces, 4096).select("row", "length", "sequence_id", "offset").collect()
    assert sorted(r["row"] for r in found) == list(range(len(sizes)))
    low = -(-int(sizes.sum()) // 4096)
    assert check_places(found, 4096) <= 1.005 * low
