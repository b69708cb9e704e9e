"""Position-sorted text in gzip blocks with an index beside it: a data source that reads the blocks of a region and no others, and the sink for it.

A file is a row of small gzip members, so any block can be inflated by itself; the index (.tbi) names, for each contig, the ranges of
blocks behind each bin of the binning tree, and the least block of each window of 16,384 bases. Filters on chromosome, position
and stop that Spark pushes down become such ranges; a partition is a run of blocks of about SPLIT_BYTES. Without
filters all blocks are read, in as many partitions. Spark applies the filters again, so rows are exact whatever the index covers.

Files are opened through pyarrow's file systems, on executors too. An index is bounded by its genome, and is read where the partitions are planned. A file without
blocks, or without an index beside it, raises an error: plain gzip would be one task.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "chromosome string, position long, stop long, line string"
#: Compressed bytes in a partition, about, and lines in a batch.
SPLIT_BYTES = 4 << 20
BATCH_LINES = 8192
#: Fixed values of the index format: bits of a window, levels of the binning tree, the largest place, bytes in a block, columns and format of VCF.
WINDOW_BITS, LEVELS, FURTHEST, BLOCK_BYTES = 14, 5, 1 << 29, 0xFF00
VCF_FORMAT = (2, 1, 2, 0, ord("#"), 0)
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds a half-open span from 0."""
    first = ((1 << 3 * LEVELS) - 1) // 7
    for level in range(LEVELS, 0, -1):
        shift = WINDOW_BITS + 3 * (LEVELS - level)
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
        first -= 1 << 3 * (level - 1)
    return 0


def bins_of(start: int, end: int) -> list[int]:
    """All bins that can hold something that overlaps a half-open span."""
    out, first = [], 0
    for level in range(LEVELS + 1):
        shift = WINDOW_BITS + 3 * (LEVELS - level)
        out += range(first + (start >> shift), first + ((end - 1) >> shift) + 1)
        first += 1 << 3 * level
    return out


@dataclass
class Index:
    """Ranges of blocks by contig and bin, and the least place by contig and window. Places are virtual: 48 bits of a block, 16 within it."""

    contigs: dict[str, int] = field(default_factory=dict)
    bins: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)
    windows: list[list[int | None]] = field(default_factory=list)

    def add(self, contig: str, start: int, end: int, low: int, high: int) -> None:
        """A line of a half-open span from 0 that lies from low to high. Lines come in order."""
        if contig not in self.contigs:
            self.contigs[contig] = len(self.bins)
            self.bins.append({})
            self.windows.append([])
        at = self.contigs[contig]
        runs = self.bins[at].setdefault(bin_of(start, end), [])
        if runs and runs[-1][1] >> 16 == low >> 16:
            runs[-1] = (runs[-1][0], high)
        else:
            runs.append((low, high))
        windows = self.windows[at]
        for w in range(start >> WINDOW_BITS, ((end - 1) >> WINDOW_BITS) + 1):
            windows += [None] * (w + 1 - len(windows))
            windows[w] = low if windows[w] is None else windows[w]

    def dumps(self) -> bytes:
        names = b"".join(name.encode() + b"\0" for name in self.contigs)
        out = [b"TBI\1", struct.pack("<8i", len(self.bins), *VCF_FORMAT, len(names)), names]
        for bins, windows in zip(self.bins, self.windows, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for number, runs in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(runs)) + b"".join(struct.pack("<2Q", *run) for run in runs))
            filled, last = [], 0
            for w in windows:
                last = last if w is None else w  # one without lines of its own begins where the one before does
                filled.append(last)
            out.append(struct.pack(f"<i{len(filled)}Q", len(filled), *filled))
        return b"".join(out)

    @classmethod
    def loads(cls, raw: bytes) -> Index:
        if raw[:4] != b"TBI\1":
            raise ValueError("no index of this format")
        n, *_, length = struct.unpack_from("<8i", raw, 4)
        names = raw[36 : 36 + length].split(b"\0")[:n]
        out, at = cls({name.decode(): k for k, name in enumerate(names)}), 36 + length
        for _ in range(n):
            (count,) = struct.unpack_from("<i", raw, at)
            at += 4
            bins = {}
            for _ in range(count):
                number, runs = struct.unpack_from("<Ii", raw, at)
                flat = struct.unpack_from(f"<{2 * runs}Q", raw, at + 8)
                bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
                at += 8 + 16 * runs
            (count,) = struct.unpack_from("<i", raw, at)
            out.windows.append(list(struct.unpack_from(f"<{count}Q", raw, at + 4)))
            at += 4 + 8 * count
            out.bins.append({k: v for k, v in bins.items() if k <= bin_of(FURTHEST - 1, FURTHEST)})  # others hold statistics
        return out

    def ranges(self, contig: str | None, start: int, end: int) -> list[tuple[int, int]]:
        """Ranges that may hold lines of a contig (None: all of them) that overlap a half-open span from 0, merged and in order."""
        found = []
        for name, at in self.contigs.items():
            if contig is not None and name != contig:
                continue
            low, high = max(start, 0), min(end, FURTHEST)
            if low >= high:
                continue
            bins, windows = self.bins[at], self.windows[at]
            least = windows[min(low >> WINDOW_BITS, len(windows) - 1)] if windows else 0
            wanted = bins if low == 0 and high == FURTHEST else filter(bins.__contains__, bins_of(low, high))
            found += [(max(a, least), b) for k in wanted for a, b in bins[k] if b > least]
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


def _system(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _url(path: str) -> str:
    """file:/a is file:///a."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def data_files(path: str) -> list[str]:
    """The block files that a path names: itself, or what it holds."""
    system, inner = _system(_url(path))
    info = system.get_file_info(inner)
    if info.type is pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type is pafs.FileType.File:
        return [inner]
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".gz") and not f.base_name.startswith(("_", ".")))


def read_block(file, at: int) -> tuple[bytes, int]:
    """The text of the block at a place of the file, and the place of the next one."""
    file.seek(at)
    head = file.read(18)
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        raise ValueError("no gzip block here: the file is not made of blocks (plain gzip can't be read by region)")
    size = struct.unpack_from("<H", head, 16)[0] + 1
    body = file.read(size - 18)
    return zlib.decompress(body[:-8], -15), at + size


def lines_between(file, low: int, high: int) -> Iterator[bytes]:
    """The lines that begin from one virtual place to before another."""
    at, skip, rest = low >> 16, low & 0xFFFF, b""
    last, within = high >> 16, high & 0xFFFF
    begun = None  # where the line in rest begins
    while at <= last:
        if at == last and not within and begun is None:
            return
        text, after = read_block(file, at)
        if not text and after > last:
            break
        start = skip
        while True:
            if begun is None and (at, start) >= (last, within):
                return
            end = text.find(b"\n", start)
            if end < 0:
                if start < len(text):
                    begun = (at, start) if begun is None else begun
                    rest += text[start:]
                break
            yield rest + text[start:end]
            rest, begun, start = b"", None, end + 1
        at, skip = after, 0
        if begun is not None and at > last:
            last, within = at, 0  # the line goes on
    if rest:
        yield rest


@dataclass
class Blocks(InputPartition):
    file: str
    low: int
    high: int


@dataclass
class Region:
    """What pushed filters ask for: contigs (None: all) and the least and greatest place, from 1, inclusive."""

    contigs: list[str] | None = None
    least: int = 1
    most: int = FURTHEST

    def narrow(self, one: Filter) -> None:
        column, value = one.attribute[0], one.value
        if column == "chromosome" and isinstance(one, (EqualTo, In)):
            names = [value] if isinstance(one, EqualTo) else list(value)
            self.contigs = names if self.contigs is None else [n for n in self.contigs if n in names]
        elif column in ("position", "stop") and isinstance(value, int):
            if isinstance(one, EqualTo):
                self.least, self.most = max(self.least, value), min(self.most, value)
            elif isinstance(one, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, value + isinstance(one, GreaterThan))
            elif isinstance(one, (LessThan, LessThanOrEqual)):
                self.most = min(self.most, value - isinstance(one, LessThan))

    def span(self) -> tuple[int, int]:
        """Half open, from 0. A line with a position up to the most and a stop from the least on overlaps it, also where the bounds cross."""
        return min(self.least, self.most) - 1, self.most


class BlockReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.region = path, split, Region()

    def pushFilters(self, filters):
        for one in filters:
            if hasattr(one, "attribute") and hasattr(one, "value") and len(one.attribute) == 1:
                self.region.narrow(one)
            yield one  # Spark applies all of them again

    def partitions(self):
        system, _ = _system(_url(self.path))
        out = []
        for file in data_files(self.path):
            if system.get_file_info(file + ".tbi").type is pafs.FileType.NotFound:
                raise FileNotFoundError(f"{file} has no index beside it")
            with system.open_input_stream(file + ".tbi", compression=None) as raw:
                index = Index.loads(gzip.decompress(raw.read()))
            wanted = [None] if self.region.contigs is None else list(dict.fromkeys(n for c in self.region.contigs for n in (c, f"chr{c}", c.removeprefix("chr")) if n in index.contigs))
            for contig in wanted:
                for low, high in index.ranges(contig, *self.region.span()):
                    out += [Blocks(file, a, b) for a, b in self._runs(index, low, high)]
        return out or [Blocks("", 0, 0)]

    def _runs(self, index: Index, low: int, high: int) -> Iterator[tuple[int, int]]:
        """A range cut where the index knows a line's begin, into about equal runs."""
        if high - low <= self.split << 16:
            yield low, high
            return
        known = sorted({a for bins in index.bins for runs in bins.values() for a, _ in runs if low < a < high} | {w for ws in index.windows for w in ws if low < w < high})
        while high - low > self.split << 16:
            at = bisect_right(known, low + (self.split << 16))
            if at >= len(known):
                break
            yield low, known[at]
            low = known[at]
        yield low, high

    def read(self, partition):
        if not partition.file:
            return
        system, _ = _system(_url(self.path))
        held: list[tuple] = []
        with system.open_input_file(partition.file) as file:
            for raw in lines_between(file, partition.low, partition.high):
                if raw and not raw.startswith(b"#"):
                    held.append(_fields(raw.decode("utf-8")))
                    if len(held) == BATCH_LINES:
                        yield _batch(held)
                        held = []
        if held:
            yield _batch(held)


def _fields(line: str) -> tuple[str, int, int, str]:
    contig, position, _, ref, _ = line.split("\t", 4)
    return contig.removeprefix("chr"), int(position), int(position) + max(len(ref), 1) - 1, line


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chromosome", "position", "stop", "line"])


class BlockSource(DataSource):
    """Lines of VCF files in blocks: chromosome (without chr), position, stop (of the reference allele) and the line."""

    @classmethod
    def name(cls):
        return "vcf_blocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BlockReader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))


def read_blocks(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """SCHEMA of a file, or of all files of a folder. Filters on chromosome, position and stop choose the blocks that are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)
    return spark.read.format("vcf_blocks").option("split", split).load(path)


def read_region(spark: SparkSession, path: str, chromosome: str, start: int, end: int) -> DataFrame:
    """Lines whose reference allele overlaps a region (from 1, inclusive)."""
    rows = read_blocks(spark, path)
    return rows.where((F.col("chromosome") == chromosome.removeprefix("chr")) & (F.col("position") <= end) & (F.col("stop") >= start))


class BlockWriter:
    """Blocks of lines, and their index."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        self.out, self.block_bytes, self.index, self.at, self.held, self.size = out, block_bytes, Index(), 0, [], 0

    def _flush(self) -> None:
        text = b"".join(self.held)
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(text) + squeeze.flush()
        block = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<2I", zlib.crc32(text), len(text))
        self.out.write(block)
        self.at += len(block)
        self.held, self.size = [], 0

    def _put(self, raw: bytes) -> None:
        while raw:
            part, raw = raw[: self.block_bytes - self.size], raw[self.block_bytes - self.size :]
            self.held.append(part)
            self.size += len(part)
            if self.size == self.block_bytes:
                self._flush()

    def place(self) -> int:
        return self.at << 16 | self.size

    def write(self, line: str) -> None:
        raw, low = line.encode("utf-8") + b"\n", self.place()
        self._put(raw)
        if not line.startswith("#"):
            contig, position, _, ref, _ = line.split("\t", 4)
            start = max(int(position) - 1, 0)
            self.index.add(contig, start, start + max(len(ref), 1), low, self.place())

    def close(self) -> bytes:
        """Ends the file; the index, in blocks too."""
        if self.size:
            self._flush()
        self.out.write(END_OF_FILE)
        return gzip.compress(self.index.dumps(), mtime=0)


def write_blocks(lines: DataFrame, header: list[str], path: str, block_bytes: int = BLOCK_BYTES, by_chromosome: bool = False) -> DataFrame:
    """Writes whole VCF lines (chromosome, position, line) as sorted files of blocks with indexes; every file begins with the header. A row for each file: file, chromosome (the first in it), n_lines.

    Lines are range-partitioned by chromosome and position, so a large chromosome is several files and no task holds one; by_chromosome: no file has two, and each has a
    folder. A file and its index appear under their names when they are whole, so a lost task is simply run again."""
    where = _url(path)
    chosen = lines.select("chromosome", "position", "line").repartitionByRange("chromosome", "position", "line").sortWithinPartitions("chromosome", "position", "line")

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        system, top = _system(where)
        part = f"{context.partitionId():05d}"
        writer = file = now = None
        n = 0

        def begin(contig):
            folder = f"{top}/{contig}" if by_chromosome else top
            system.create_dir(folder, recursive=True)
            aside = f"{folder}/_aside-{part}-{context.taskAttemptId()}"
            out = system.open_output_stream(aside, compression=None)
            made = BlockWriter(out, block_bytes)
            for one in header:
                made.write(one)
            return made, (out, aside, f"{folder}/part-{part}.vcf.gz")

        def end():
            out, aside, name = file
            index = writer.close()
            out.close()
            with system.open_output_stream(f"{aside}.tbi", compression=None) as beside:
                beside.write(index)
            system.move(f"{aside}.tbi", f"{name}.tbi")
            system.move(aside, name)
            return pa.RecordBatch.from_pydict({"file": [name], "chromosome": [now], "n_lines": [n]})

        for batch in batches:
            for contig, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if writer is None or (by_chromosome and contig != now):
                    if writer is not None:
                        yield end()
                    (writer, file), now, n = begin(contig), contig, 0
                writer.write(line)
                n += 1
        if writer is not None:
            yield end()

    schema = "file string, chromosome string, n_lines long"
    return lines.sparkSession.createDataFrame(chosen.mapInArrow(write, schema).collect(), schema)  # a row for each file


def vcf_lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The header of VCF files, and their whole lines with chromosome (as it stands) and position. A header is bounded; that of files with different ones is all lines, each once, column names last."""
    text = spark.read.text(path).where(F.trim("value") != "")
    header = [r[0] for r in text.where(F.startswith("value", F.lit("#"))).withColumn("n", F.monotonically_increasing_id()).groupBy("value").agg(F.min("n").alias("n")).orderBy(F.startswith("value", F.lit("#CHROM")), "n").collect()]
    rows = text.where(~F.startswith("value", F.lit("#")))
    part = lambda k: F.split_part("value", F.lit("\t"), F.lit(k))
    return header, rows.select(part(1).alias("chromosome"), part(2).try_cast("long").alias("position"), F.col("value").alias("line"))


def renamed_lines(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Lines under other contig names, whole otherwise. names: old and new; contigs without a new name are left out."""
    rest = F.expr("substr(line, length(chromosome) + 1)")
    return lines.join(names, lines["chromosome"] == names["old"]).select(F.col("new").alias("chromosome"), "position", F.concat("new", rest).alias("line"))


def split_by_chromosome(spark: SparkSession, path: str, out: str, names: DataFrame | None = None) -> DataFrame:
    """VCF files as a folder of indexed files for each chromosome, with the header and every line as it was. Lines without a position raise an error."""
    header, lines = vcf_lines(spark, path)
    fine = F.when(F.col("position").isNotNull(), F.col("position")).otherwise(F.raise_error(F.concat(F.lit("no position: "), "line")).cast("long"))
    lines = lines.withColumn("position", fine)
    return write_blocks(lines if names is None else renamed_lines(lines, names), header, out, by_chromosome=True)


def extract_fields(lines: DataFrame, wanted: list[str]) -> DataFrame:
    """Columns of VCF lines by name: CHROM to INFO, INFO/key (`.` where a line lacks it, 1 for a flag), and the line's chromosome. Null for a column that a line is too short for."""
    fixed = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
    parts = F.split("line", "\t", -1)
    out = []
    for name in wanted:
        if name.startswith("INFO/"):
            key = name[5:]
            entries = F.filter(F.split(F.get(parts, F.lit(7)), ";"), lambda e: (e == key) | F.startswith(e, F.lit(f"{key}=")))  # noqa: B023
            entry = F.get(entries, F.lit(0))
            out.append(F.when(entry.isNull(), ".").when(entry == key, "1").otherwise(F.substr(entry, F.lit(len(key) + 2))).alias(name))
        else:
            out.append(F.get(parts, F.lit(fixed.index(name))).alias(name))
    return lines.select(*out)
