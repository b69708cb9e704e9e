"""The R-tree, large blocks in two steps, and rows that share an id or have none."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import jaccard
from tests.llm.test_operators import brute_components


def families(rng, n, words=60):
    """Families of near copies, among them chains whose ends are not similar, and texts of their own."""
    rows = []
    for f in range(n):
        base = [f"f{f}w{rng.randrange(5000)}" for _ in range(words)]
        for k in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(k // 3):
                copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
            if f % 3 == 0:  # each copy of the one before: a chain
                base = [*copy[:-1], f"c{rng.randrange(10**6)}"]
    return rows


def sets_of(rng, n):
    sizes = rng.integers(5, 400, n)
    return [np.unique(rng.integers(-(2**62), 2**62, s)) for s in sizes]


def test_descent_keeps_what_can_reach():
    rng = np.random.default_rng(3)
    sets = sets_of(rng, 4000)
    sets += [np.unique(np.concatenate([s[: int(0.95 * len(s))], rng.integers(-(2**62), 2**62, 2)])) for s in sets[:80]]
    sizes = np.array([len(s) for s in sets])
    points = jaccard.count_points(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets))
    tree = jaccard.Tree(sizes, points)
    assert len(tree.levels) > 2 and len(tree.levels[-1][0]) == 1
    pairs, seen = tree.near_pairs()
    leaf_of = {int(i): k for k, leaf in enumerate(tree.leaves) for i in leaf}
    kept = {tuple(p) for p in pairs.tolist()}
    for i in range(80):
        both = len(np.intersect1d(sets[i], sets[4000 + i]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[4000 + i]) - both):
            assert tuple(sorted((leaf_of[i], leaf_of[4000 + i]))) in kept
    every = len(tree.leaves) * (len(tree.leaves) + 1) // 2
    assert len(kept) < 0.5 * every  # what the tree leaves out
    assert len(jaccard.link_forest(np.arange(len(sets)), np.zeros(len(sets), int), sets)) >= 60


def test_groups_are_not_linked_again():
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 200)
    sets = [np.unique(np.concatenate([base, rng.integers(-(2**62), 2**62, 2)])) for _ in range(50)]
    links = jaccard.link_forest(np.arange(50), np.zeros(50, int), sets, np.arange(50) // 10)
    assert len(links) == 4
    sides = (np.arange(50) < 10).astype(int)
    assert len(jaccard.link_forest(np.arange(50), sides, sets, np.where(sides, 0, np.arange(50)))) == 40


@pytest.mark.parametrize("hubs", [0, 2])
def test_large_blocks(spark, monkeypatch, hubs):
    monkeypatch.setattr(jaccard, "CELL_ROWS", 6)
    monkeypatch.setattr(jaccard, "HUBS", hubs)
    rng = random.Random(hubs)
    shared = " ".join(f"s{k}" for k in range(30))  # a passage that puts families into one block
    rows = [(k, t if k % 2 else t + " " + shared) for k, t in enumerate(families(rng, 14))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(frame).collect())
    assert found == brute_components(rows)


def test_one_of_each(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (9, b + " more"), (None, c), (None, c), (7, a), (3, None), (3, None), (4, ""), (8, "two words"), (6, "TWO words")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row_ string").coalesce(1)
    left = sorted(((r["doc_id"] or -1, r["text"]) for r in jaccard.one_of_each(frame).collect()), key=str)
    assert left == sorted([(5, a), (5, b), (-1, c), (3, None), (3, None), (4, ""), (6, "TWO words")], key=str)
    assert jaccard.one_of_each(frame.limit(0)).count() == 0
