"""Queries over whole tables, against brute force on small tables with rows that the filtered queries leave out."""

from __future__ import annotations

import pytest

from strandloom.plans.registry import QUERIES


def chromosome(c):
    return {22: "chrX", 23: "chrY", 24: "chrM"}.get(c, f"chr{c + 1}")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    rows = {
        "orders": ([(k, 10 + k % 30, 200.0 * (k % 70), "OF"[k % 2]) for k in [*range(1, 120), 4990, 5001, 5002, 6003]], "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string"),
        "lineitem": ([(k, n, 1 + (k * n) % 30, 1 + k % 7, "NRA"[k % 3]) for k in [*range(1, 120), 5001, 7000] for n in (1, 2)], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string"),
        "part": ([(k,) for k in range(1, 6)], "p_partkey long"),
        "customer": ([(k, f"c{k}") for k in (1, 60, 100, 101, 250)], "c_custkey long, c_name string"),
        "supplier": ([(k, f"s{k}") for k in (1, 10, 51, 200, 300)], "s_suppkey long, s_name string"),
        "events": ([(3, 60.0), (3, 70.0), (199, 10.0), (200, 90.0), (1499, 5.0), (None, 99.0)], "user_id long, value double"),
    }
    for name, (found, schema) in rows.items():
        spark.createDataFrame(found, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder, {name: found for name, (found, _) in rows.items()}


def brute(t):
    intervals = [(k, c % 25, 10 * k, 10 * k + int(price // 200)) for k, c, price, _ in t["orders"]]
    points = [(k, n, s % 25, 10 * k + n) for k, n, s, _, _ in t["lineitem"]]
    near = [(p, g) for p in points for g in intervals if p[2] == g[1] and g[2] - 500 <= p[3] <= g[3] + 500]
    positions = {}
    for p, g in near:
        key = g[0], "upstream" if p[3] < g[2] else "downstream" if p[3] > g[3] else "in gene"
        positions[key] = positions.get(key, 0) + 1
    status = {k: x for k, _, _, x in t["orders"]}
    parts = {k for (k,) in t["part"]}
    merged = {k + 50: v for k, v in t["supplier"]} | dict(t["customer"])
    tracks = {u for u, _ in t["events"] if u is not None}
    return {
        "flank_join_whole": [(p[0], p[1], g[0]) for p, g in near],
        "relative_position_whole": [(*k, n) for k, n in positions.items()],
        "chrom_sort_whole": [(i[0], i[1] + 1, n + 1) for n, i in enumerate(sorted(intervals, key=lambda i: (i[1], i[2], i[0])))],
        "region_format_whole": [(k, f"{chromosome(c)}:{s}-{e}{':-' if k % 2 == 0 else ''}", chromosome(c), s) for k, c, s, e in intervals],
        "variant_associations_whole": [(p, k, n, flag if flag != "N" else status.get(k)) for k, n, _, p, flag in t["lineitem"] if p in parts],
        "merge_track_lists_whole": list(merged.items()),
        "counts_with_zeros_whole": [(u, sum(v > 50 for x, v in t["events"] if x == u)) for u in tracks],
    }


@pytest.mark.parametrize("name", ["flank_join", "relative_position", "chrom_sort", "region_format", "variant_associations", "merge_track_lists", "counts_with_zeros"])
def test_whole(spark, tables, name):
    folder, rows = tables
    found = [tuple(r) for r in QUERIES[f"{name}_whole"](spark, folder).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute(rows)[f"{name}_whole"]))
