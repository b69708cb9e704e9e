"""Mixing: rows of size 0 in capped sources, and input columns named like what the operator makes."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.llm import mixing

N_WORDS = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """A large source and three small ones, which reach their cap; many rows of them have no words."""
    rows = [(k, "word " * (k % 40 + 20), "big") for k in range(300)]
    rows += [(1000 + k, [None, "", "  ", "a b c"][k % 4], f"small{k % 3}") for k in range(240)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_no_row_comes_four_times(docs):
    rows = mixing.mix(docs, n_shards=4).collect()
    assert {r["copies"] for r in rows if r["source"] != "big"} == {3} and max(r["copies"] for r in rows) <= 3
    times = Counter(r["doc_id"] for r in rows if r["epoch"] is not None)
    assert max(times.values()) <= 3
    for s in ("small0", "small1", "small2"):
        taken = sum(r["size"] for r in rows if r["source"] == s and r["epoch"] is not None)
        assert taken == 3 * sum(N_WORDS(r["text"]) for r in docs.collect() if r["source"] == s) == rows[[r["source"] for r in rows].index(s)]["target"]


@pytest.mark.parametrize("names", [("base", "last", "shards", "_h", "_of"), ("of_", "BASE_", "last_", "shards_", "h_"), ("size", "target", "copies", "epoch", "SHARD", "place")])
def test_clashing_columns(docs, names):
    odd = docs.withColumns({n: F.lit("mine") for n in names})
    key = lambda rows: Counter((r["doc_id"], r["epoch"], r["shard"]) for r in rows)
    found = mixing.mix(odd, n_shards=4).collect()
    assert key(found) == key(mixing.mix(docs, n_shards=4).collect())
    kept = [n for n in names if n.lower() not in mixing.OUTPUT]
    assert all(r[n] == "mine" for r in found[:20] for n in kept)


def test_sources_without_words(spark):
    frame = spark.createDataFrame([(1, None, None), (2, " ", None)], "doc_id long, text string, source string")
    rows = mixing.mix(frame, n_shards=2).collect()
    assert [(r["target"], r["copies"], r["epoch"]) for r in rows] == [(0.0, 0, None)] * 2


def test_lanes_follow_the_input():
    assert mixing.lanes_for(0, 0, 64) == 1
    assert mixing.lanes_for(10**11, 10**13, 64) == 10**13 // (64 * mixing.LANE_WORDS) + 1
