"""Iterative plans, bins by arithmetic, re-ranking and the fields of the filter language that have a meaning of their own."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandloom.operators import annotation, filters, intervals, rag
from strandloom.sources import genomic


def test_merges_with_cycles(spark):
    links = [(f"rs{k}", f"rs{k + 1}") for k in range(40)] + [("rs100", "rs101"), ("rs101", "rs100"), ("rs102", "rs100"), ("rs7x", "rs9x")]
    found = {r[0]: r[1] for r in genomic.resolve_merges(spark.createDataFrame(links, "ref_snp_id string, merged_into string")).collect()}
    assert found == {f"rs{k}": "rs40" for k in range(40)} | {"rs100": None, "rs101": None, "rs102": None, "rs7x": "rs9x"}


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "a long, b long")
    start = spark.createDataFrame([(1,), (9,)], "node long")
    assert {tuple(r) for r in rag.reach(edges, start, 10).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (9, 0)}


def test_bins_against_the_tree(spark):
    rng = random.Random(6)
    lengths = spark.createDataFrame([("a", 1_000_003), ("b", 15_625), ("c", 70_001)], "chromosome string, end long")
    tree = {}
    for r in intervals.bin_tree(spark, [tuple(x) for x in lengths.collect()]).collect():
        tree.setdefault(r["chromosome"], []).append((r["level"], r["start"], r["end"], r["path"]))
    rows = [(k, c, s, s + rng.choice([0, 5, 900, 20_000, 400_000])) for k in range(400) for c in [rng.choice("abcz")] for s in [rng.randrange(0, 90_000 if c == "c" else 1_000_003)]]
    found = {r["id"]: r["path"] for r in intervals.assign_bins(spark.createDataFrame(rows, "id long, chromosome string, s long, e long"), lengths).collect()}
    for k, c, s, e in rows:
        holding = [(level, path) for level, a, b, path in tree.get(c, []) if a <= s and e <= b]
        assert found[k] == (max(holding)[1] if holding else None)
    over = intervals.assign_bins(spark.createDataFrame([("b", 15_000, 99_999)], "chromosome string, s long, e long"), lengths, clamp=True).first()
    assert over["path"] == "b"


def test_unknown_combinations_are_ranked_anew(spark):
    rows = spark.createDataFrame([(["intron_variant", "missense_variant"],), (["stop_gained"],), (["missense_variant", "intron_variant"],)], "terms array<string>")
    table = annotation.rank_combos(annotation.default_combos(spark))
    before = {r["key"]: r["rank"] for r in table.collect()}
    found = [(sorted(r["terms"]), r["rank"]) for r in annotation.rank_consequences(rows, table).collect()]
    whole = {r["key"]: r["rank"] for r in annotation.rank_combos(annotation.default_combos(spark, rows)).collect()}
    assert all(rank == whole[",".join(terms)] for terms, rank in found) and len({rank for terms, rank in found if len(terms) == 2}) == 1
    assert len(whole) == len(before) + 1
    assert annotation.extended_ranks(rows.where(F.size("terms") == 1), table) is table


def test_cells_and_tissues(spark):
    schema = "id long, experimental_design struct<assay: string>, biosample_characteristics struct<biosample_type: string, tissue: string, biosample: array<struct<term: string>>>"
    rows = [(1, ("ATAC",), ("cell line", "brain cortex", [("astrocyte of cortex",)])), (2, ("ATAC",), ("tissue", "brain", [("astrocyte",)])), (3, ("ATAC",), ("primary cell", None, [("neuron",), ("glia",)])), (4, ("ATAC",), (None, "blood", None))]
    tracks = spark.createDataFrame(rows, schema)
    ids = lambda text: {r["id"] for r in tracks.where(filters.condition(text, filters.TRACK_FIELDS)).collect()}
    assert ids("cell eq astrocyte") == {1} and ids("cell neq astrocyte") == {3} and ids("cell like glia") == {3}
    assert ids("tissue eq brain") == {1, 2} and ids("tissue neq brain") == {4} and ids("tissue like cort and assay eq ATAC") == {1}


def test_overlaps_without_a_width(spark):
    rng = random.Random(9)
    span = lambda k: (k, rng.choice("ab"), (s := rng.randrange(50_000)), s + rng.choice([0, 3, 200, 5_000, 40_000]))
    left, right = [span(k) for k in range(120)], [span(k) for k in range(150)]
    l_rows = spark.createDataFrame(left, "l_id long, l_c string, l_s long, l_e long")
    r_rows = spark.createDataFrame(right, "r_id long, r_c string, r_s long, r_e long")
    for flank in (0, 100):
        found = sorted((r["l_id"], r["r_id"]) for r in intervals.overlap_join(l_rows, r_rows, ("l_c", "r_c"), flank=flank).collect())
        assert found == sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] <= b[3] + flank and b[2] - flank <= a[3])
    none = intervals.overlap_join(l_rows.limit(0), r_rows, ("l_c", "r_c"))
    assert none.count() == 0
