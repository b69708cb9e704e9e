"""Indexed block files: what a region reads, against all lines."""

from __future__ import annotations

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

from strandloom.sources import blocks as B

BLOCK = 2000
HEADER = ["##fileformat=VCFv4.2", "##contig=<ID=chr1>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]


def random_lines(n=6000, seed=2):
    rnd = random.Random(seed)
    rows = sorted({(f"chr{rnd.choice([1, 1, 1, 2, 10])}", rnd.randint(1, 3_000_000)) for _ in range(n)})
    return [f"{c}\t{p}\trs{k}\t{'ACGT'[k % 4] * rnd.choice([1, 1, 1, 40, 30_000 if k % 500 == 0 else 2])}\tT\t{k % 99}\tPASS\tA={k};B={'x' * rnd.randint(0, 60)}" for k, (c, p) in enumerate(rows)]


@pytest.fixture(scope="module")
def lines():
    return random_lines()


@pytest.fixture(scope="module")
def folder(spark, lines, tmp_path_factory):
    where = f"file:{tmp_path_factory.mktemp('blocks')}/out"
    rows = [(x.split("\t")[0], int(x.split("\t")[1]), x) for x in lines]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = B.write_blocks(spark.createDataFrame(rows, "chromosome string, position long, line string"), HEADER, where, BLOCK).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["n_lines"] for r in files) == len(lines) and len(files) == int(before)
    return where


def overlapping(lines, chromosome, start, end):
    out = []
    for x in lines:
        c, p, _, ref, _ = x.split("\t", 4)
        if c == f"chr{chromosome}" and int(p) <= end and int(p) + len(ref) - 1 >= start:
            out.append(x)
    return sorted(out)


def test_files_are_gzip_with_headers(spark, lines, folder):
    seen = []
    for file in B.data_files(folder):
        text = gzip.open(file, "rt").read().splitlines()
        assert text[: len(HEADER)] == HEADER
        body = text[len(HEADER) :]
        assert body == sorted(body, key=lambda x: (x.split("\t")[0], int(x.split("\t")[1]), x))
        seen += body
    assert sorted(seen) == sorted(lines)


@pytest.mark.parametrize("region", [("1", 100_000, 140_000), ("chr2", 1, 3_000_000), ("10", 2_000_000, 2_000_001), ("1", 1_500_000, 1_500_000), ("3", 1, 10), ("1", 5_000_000, 6_000_000)])
def test_regions(spark, lines, folder, region):
    found = sorted(r["line"] for r in B.read_region(spark, folder, *region).collect())
    assert found == overlapping(lines, region[0].removeprefix("chr"), *region[1:])


def test_whole_folder_in_small_partitions(spark, lines, folder):
    rows = B.read_blocks(spark, folder, split=1)
    assert rows.rdd.getNumPartitions() > B.read_blocks(spark, folder).rdd.getNumPartitions() + 5
    assert sorted(r["line"] for r in rows.collect()) == sorted(lines)
    assert rows.where((F.col("position") > 10) & (F.col("chromosome").isin("1", "10")) & (F.col("position") < 500_000)).count() == sum(x.split("\t")[0] in ("chr1", "chr10") and 10 < int(x.split("\t")[1]) < 500_000 for x in lines)


def test_a_region_inflates_its_blocks_only(folder, lines, monkeypatch):
    reader = B.BlockReader(folder, B.SPLIT_BYTES)
    assert len(list(reader.pushFilters([EqualTo(("chromosome",), "1"), GreaterThanOrEqual(("stop",), 700_000), LessThanOrEqual(("position",), 740_000)]))) == 3
    inflated = []
    whole = B.read_block
    monkeypatch.setattr(B, "read_block", lambda file, at: inflated.append(at) or whole(file, at))
    rows = [line for part in reader.partitions() for batch in reader.read(part) for line in batch.column(3).to_pylist()]
    assert set(overlapping(lines, "1", 700_000, 740_000)) <= set(rows)
    everything = 0
    for name in B.data_files(folder):
        with open(name, "rb") as file:
            at = 0
            while at < len(open(name, "rb").read()):
                _, at = whole(file, at)
                everything += 1
    needed = sum(len(x) for x in overlapping(lines, "1", 700_000, 740_000)) / BLOCK
    assert 0 < len(inflated) <= needed + 12 < everything / 4
    reader.region = B.Region(["nothing"])
    assert not [b for part in reader.partitions() for b in reader.read(part)]


def test_plain_gzip_and_missing_indexes_raise(spark, tmp_path):
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as out:
        out.write("chr1\t1\t.\tA\tT\t.\n")
    with pytest.raises(Exception, match="no index"):
        B.read_region(spark, str(tmp_path), "1", 1, 5).collect()
    with pytest.raises(ValueError, match="not made of blocks"):
        B.read_block(io.BytesIO((tmp_path / "a.vcf.gz").read_bytes()), 0)


def test_long_lines_run_over_blocks():
    out = io.BytesIO()
    writer = B.BlockWriter(out)
    lines = [f"1\t{k * 10 + 1}\t.\tA\tT\t{'z' * n}" for k, n in enumerate([5, 200_000, 3, B.BLOCK_BYTES - 12, 0, 70_000])]
    for x in lines:
        writer.write(x)
    index = B.Index.loads(gzip.decompress(writer.close()))
    assert gzip.decompress(out.getvalue()).decode().splitlines() == lines
    out.seek(0)
    (low, high), = index.ranges(None, 0, B.FURTHEST)
    assert [x.decode() for x in B.lines_between(out, low, high)] == lines


def test_split_keeps_lines_and_headers(spark, tmp_path):
    lines = ["chr2\t7\trs1\tA\tT\t3.5\tq10\tA=1;B\tGT\t0/1\t1/1", "chr1\t9\t.\tC\tG\t.\tPASS\t.", "chr1\t2\t.\tC\tG,T\t.\tPASS\tA=2", "chr1\t9\t.\tC\tG\t.\tPASS\t."]
    (tmp_path / "a.vcf").write_text("\n".join([*HEADER, *lines]) + "\n")
    files = B.split_by_chromosome(spark, f"{tmp_path}/a.vcf", f"{tmp_path}/out").collect()
    assert {r["chromosome"] for r in files} == {"chr1", "chr2"} and all(f"/out/{r['chromosome']}/" in r["file"] for r in files)
    for r in files:
        text = gzip.open(r["file"], "rt").read().splitlines()
        assert text[:3] == HEADER and {x.split("\t")[0] for x in text[3:]} == {r["chromosome"]}
    assert sorted(r["line"] for r in B.read_blocks(spark, f"{tmp_path}/out").collect()) == sorted(lines)
    assert [r["position"] for r in B.read_region(spark, f"{tmp_path}/out", "1", 1, 8).collect()] == [2]
    (tmp_path / "b.vcf").write_text("chr1\tx\t.\tC\tG\t.\tPASS\t.\n")
    with pytest.raises(Exception, match="no position"):
        B.split_by_chromosome(spark, f"{tmp_path}/b.vcf", f"{tmp_path}/out2")


@pytest.mark.parametrize("block", [7, 64, 300])
def test_a_cut_at_any_line_reads_each_line_once(block):
    """Also where the line at the cut is the last of its block and runs on into the next ones."""
    rnd = random.Random(4)
    out = io.BytesIO()
    writer = B.BlockWriter(out, block)
    lines, places = [f"chr1\t{k + 1}\t.\tA\tT\t{'z' * rnd.choice([0, 5, 40, 150, 900])}" for k in range(120)], []
    for x in lines:
        places.append(writer.place())
        writer.write(x)
    writer.close()
    end = writer.at << 16
    for n, cut in enumerate(places):
        assert [x.decode() for x in B.lines_between(out, 0, cut)] == lines[:n]
        assert [x.decode() for x in B.lines_between(out, cut, end)] == lines[n:]
