from __future__ import annotations

import random

import pytest

from strandloom.operators import annotation as A
from strandloom.operators import intervals as I


@pytest.mark.parametrize("seed,width,flank", [(1, 16, 0), (2, 64, 5), (3, 4, 0)])
def test_overlap_join_is_the_theta_join(spark, seed, width, flank):
    rng = random.Random(seed)
    make = lambda n: [(k, rng.randrange(3), s := rng.randrange(0, 3000), s + rng.choice([0, 3, 40, 2500])) for k in range(n)]
    left, right = make(120), make(90)
    a, b = spark.createDataFrame(left, "l_id long, l_c long, l_s long, l_e long"), spark.createDataFrame(right, "r_id long, r_c long, r_s long, r_e long")
    got = sorted((r["l_id"], r["r_id"]) for r in I.overlap_join(a, b, ("l_c", "r_c"), width, flank).collect())
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= y[3] + flank and y[2] - flank <= x[3])
    assert got == want


def test_bin_tree(spark):
    rows = I.bin_tree(spark, [("chrX", 156_040_895)]).collect()
    assert len(rows) == 16_383 and max(r["level"] for r in rows) == 13
    leaves = [r for r in rows if r["level"] == 13]
    assert sum(r["end"] - r["start"] + 1 for r in leaves) == 156_040_895


def _rank(combos):
    """The ranking rules in plain Python."""
    complete = {}
    for k, t in enumerate([*A.HIGH_IMPACT, *A.NMD, *A.MODIFIER]):
        complete[t] = k + 1
    order = []
    for name, group in A.GROUPS.items():
        if name == "MODIFIER":
            members = [c for c in combos if set(c) <= set(group)]
        else:
            members = [c for c in combos if set(c) & set(group)]
            if name == "HIGH_IMPACT":
                members = [c for c in members if not set(c) & {*A.NMD, *A.NON_CODING}]
        places = {t: k + 1 for k, t in enumerate(group)} if name in ("HIGH_IMPACT", "MODIFIER") else complete
        keyed = [("".join(sorted(chr(64 + places[t]) for t in c)), ",".join(sorted(c))) for c in members]
        order += [k for _, k in sorted(keyed, key=lambda x: (x[0][0], -len(x[0]), x[0], x[1]))]
    last = {k: n for n, k in enumerate(order)}
    return {k: n + 1 for n, k in enumerate(sorted(last, key=last.get))}


def test_consequence_ranks(spark):
    combos = [["stop_gained"], ["missense_variant", "splice_region_variant"], ["intron_variant", "NMD_transcript_variant"], ["intron_variant", "non_coding_transcript_variant"], ["intron_variant"], ["intergenic_variant"], ["missense_variant"]]
    got = {r["key"]: r["rank"] for r in A.rank_combos(spark.createDataFrame([(c,) for c in combos], "terms array<string>")).collect()}
    assert got == _rank(combos)
