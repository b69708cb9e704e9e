"""Places without large groups in one task, cubes of bins, bins in streams, and triples files."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandloom.operators import bin_cube
from strandloom.operators.ordering import places
from strandloom.sources import tables as S
from strandloom.streaming import ingest


def test_places(spark):
    rnd = random.Random(1)
    rows = [(k, "hot" if k % 3 else rnd.choice(["a", "b", None]), rnd.randrange(50)) for k in range(700)]
    found = places(spark.createDataFrame(rows, "id long, g string, v int").repartition(5), ["g"], [F.desc("v"), F.col("id")]).collect()
    want = {}
    for g in {r[1] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            want[r[0]] = n
    assert {r["id"]: r["place"] for r in found} == want
    every = places(spark.createDataFrame(rows, "id long, g string, v int"), [], [F.col("v"), F.col("id")]).collect()
    assert {r["id"]: r["place"] for r in every} == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1)}


def test_region_counts_equal_the_scan(spark):
    rnd = random.Random(6)
    spans = [(rnd.choice(["1", "1", "2"]), s := rnd.randint(1, 9000), s + int(rnd.expovariate(1 / 120)), rnd.choice("xy")) for _ in range(900)] + [("1", 5, 4, "x"), (None, 1, 2, "x"), ("1", None, 9, "y"), ("2", 1, 200_000, "x")]
    regions = [(k, rnd.choice(["1", "2", "3"]), a := rnd.randint(1, 9500), a + rnd.choice([0, 1, 63, 64, 1000, 9000])) for k in range(80)] + [(90, "1", 0, 5), (91, "1", 9, 8)]
    frame = spark.createDataFrame(spans, "chromosome string, s long, e long, kind string")
    asked = spark.createDataFrame(regions, "region int, chromosome string, start long, end long")
    want = {}
    for r, c, a, b in regions[:80]:
        for chrom, s, e, kind in spans:
            if chrom == c and s is not None and s <= e and s <= b and e >= a:
                want[r, kind] = want.get((r, kind), 0) + 1
    cube = bin_cube.build(frame, ["kind"], 64)
    assert {(r["region"], r["kind"]): r["n"] for r in bin_cube.region_counts(cube, asked).collect()} == want
    halves = bin_cube.added(bin_cube.build(frame.where("s % 2 = 0"), ["kind"], 64), bin_cube.build(frame.where("s % 2 = 1"), ["kind"], 64))
    assert {(r["region"], r["kind"]): r["n"] for r in bin_cube.region_counts(halves, asked).collect()} == want
    most = bin_cube.tiles(asked.where("region < 80"), 64).groupBy("region").count().agg(F.max("count")).first()[0]
    assert most <= 2 * (200_000 // 64).bit_length()  # rows of the cube that a region reads


def test_bins_leave_the_state(spark, tmp_path):
    """Ordered files, one a batch: duplicates inside a bin go, also across files; the same key in another bin stays; the state never holds more than a few bins."""
    for n in range(8):
        rows = [(100 * n + k, f"v{k % 10}") for k in range(100)] + [(100 * n + 50, "v5")] + ([(100 * n - 1, "v9")] if n else [])
        spark.createDataFrame(rows, "pos long, id string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.dropped_files(spark, f"{tmp_path}/in", "pos long, id string", files_at_once=1)
    query = ingest.load_batches(ingest.distinct_by_bin(stream, "pos", ["id"], 50), ingest.append_batches(f"{tmp_path}/out"), f"{tmp_path}/cp")
    query.awaitTermination()
    out = [(r["bin"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(out) == sorted({(p // 50, f"v{p % 10}") for p in range(800)})
    sizes = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert 0 < max(sizes) <= 50  # of 160 pairs


def test_triples_keep_names_and_literals(spark, tmp_path):
    rows = [("a b", "p", "a-b", "iri"), ("a-b", "p", "a_b", "iri"), ("ü/ß?#%20", "p q", 'say "x\\n"\n\t\\', "literal"), ("http://x.org/a_1", "p", "_:b 1", "blank"), ("s", "p", "", "literal"), (None, "p", "o", "iri")]
    frame = spark.createDataFrame(rows, "subject string, predicate string, object string, object_kind string")
    S.write_triples(frame, f"{tmp_path}/t")
    assert sorted(map(tuple, S.read_ntriples(spark, f"{tmp_path}/t").collect())) == sorted(r for r in rows if r[0])
