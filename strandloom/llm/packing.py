"""Bulk-synchronous best-fit packing of documents into sequences.

Documents are tokenised and cut into pieces of at most `capacity` ids. Pieces of one
length are a run: one row of state with a count, whatever their number; sequences that
have been filled alike are a run of equal gaps. The longest pieces open as many sequences as all ids
need together. Then come rounds: the runs of pieces and gaps are range-sorted,
largest first, and each task sweeps its range down. The sweep is a stack: a run of gaps is pushed, and a run
of pieces takes the gaps on top, which are the smallest that hold it (its
successors), as many pieces in a gap as it holds. Conflicts are resolved by rank: the
pieces of a run meet the gaps of a run in the order of their numbers. The gaps shrink, and go on in the
same sweep where their new size is in the task's range, else in the next round. Each round has
half as many ranges as the one before; the last has one, in which pieces that
found no gap anywhere open new sequences. A run leaves the state when its pieces are placed, a gap when
it is full. Lengths are whole numbers up to the capacity, so runs, rounds and the
state are bounded by the capacity and do not grow with the corpus.

Pieces get their places by number: they are range-sorted by length once (ties by a
hash, so copies do not stay together), which numbers them all, and a match of
runs is an interval of numbers. Intervals and pieces meet in blocks of consecutive numbers.

Defined results: a null text is empty and has the end id alone; very long texts are
cut into pieces, and no task holds more of one than its slice of ids; repeated rows and
equal ids are packed as often as they stand; ties of length go by a hash of the row
number. An empty table gives an empty result. Only the id and the text are read, so other columns
don't matter. The input is read once; its pieces, the order and the packed pieces are written to the shared
folder, as is the state of every round.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._shared import drop_staged, release, small_batches, staged
from strandloom.llm.tokens import encoded, tokenizer_path, vocabulary_size

#: Runs that a task sweeps in the first round.
SWEEP_RUNS = 512
#: Pieces that a task puts in order, and consecutive numbers in a block.
ORDER_ROWS = 1 << 16
BLOCK = 1 << 10

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, row long, ids binary"
#: kind of a run: gaps (sequences from `first` with `size` ids free), pieces (numbers from `first` of `size` ids), or a match.
GAP, PIECE, MATCH = 0, 1, 2
RUNS = "kind int, size int, first long, n long"
SWEPT = RUNS + ", per long, seq long, offset int"


def cut_pieces(docs: DataFrame, capacity: int, path: str | None = None, end: int = 1, id_col: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32, row (a number for each piece) and ids (null unless wanted; two bytes each where the vocabulary allows, else four)."""
    path = path or tokenizer_path("word_bpe_49k.json")
    kept = id_type(path, end)

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch, ids, sizes in encoded(batches, path, 1):
            ends = np.cumsum(sizes + 1)
            full = np.full(int(ends[-1]), end, np.uint32)
            mask = np.ones(len(full), bool)
            mask[ends - 1] = False
            full[mask] = ids
            counts = -(-(sizes + 1) // capacity)
            doc = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * capacity
            length = np.minimum(capacity, (sizes + 1)[doc] - start)
            at = (ends - sizes - 1)[doc] + start
            raw = memoryview(full.astype("<u4").tobytes())
            n = len(doc)
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            # Pieces stand one after another in the ids, so one buffer holds them all.
            flat = full.astype(kept)
            offsets = np.concatenate([at, [len(full)]]).astype(np.int32) * np.int32(flat.itemsize)
            blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())]) if with_ids else pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(row + np.arange(n), pa.int64()), blobs],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "row", "ids"],
            )
            row += n

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def id_type(path: str, end: int) -> str:
    """The narrowest of two kinds of unsigned numbers that holds all ids."""
    return "<u2" if max(vocabulary_size(path), end + 1) <= 1 << 16 else "<u4"


def _widened(kept: str, ids_at: int):
    """ids with four bytes each."""

    def run(batches):
        for batch in batches:
            ids = batch.column(ids_at)
            if kept != "<u4" and ids.null_count < len(ids):
                offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
                flat = np.frombuffer(ids.buffers()[2], kept, count=(offsets[-1] - offsets[0]) // 2, offset=offsets[0])
                ids = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(((offsets - offsets[0]) * 2).astype(np.int32)), pa.py_buffer(flat.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([ids if k == ids_at else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    return run


def sweep(runs: list[tuple[int, int, int, int]], capacity: int, opened: int | None = None) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Best fit over runs (kind, size, first, n), largest first with gaps before pieces of their size.

    Out: matches (first piece, number of pieces, pieces in a gap, first sequence, offset there, length), and the runs of pieces and of gaps that are left, (size, first, n).
    opened: the number of the next new sequence; without it pieces that find no gap are left."""
    stack: list[tuple[int, int, int]] = []  # the smallest gaps on top
    shrunk: list[tuple[int, int, int]] = []  # a heap: gaps to come, the largest first
    matches, pieces = [], []
    for kind, size, first, n in runs:
        while shrunk and -shrunk[0][0] >= size:
            gap, seq, m = heapq.heappop(shrunk)
            stack.append((-gap, seq, m))
        if kind == GAP:
            stack.append((size, first, n))
            continue
        while n:
            if not stack:
                if opened is None:
                    pieces.append((size, first, n))
                    break
                wanted = -(-n // (capacity // size))
                stack.append((capacity, opened, wanted))
                opened += wanted
            gap, seq, m = stack.pop()
            per = gap // size
            if full := min(m, n // per):
                matches.append((first, full * per, per, seq, capacity - gap, size))
                if gap > per * size:
                    heapq.heappush(shrunk, (per * size - gap, seq, full))
                first, n, seq, m = first + full * per, n - full * per, seq + full, m - full
            if m and n:  # fewer pieces than the next gap holds
                matches.append((first, n, n, seq, capacity - gap, size))
                heapq.heappush(shrunk, (n * size - gap, seq, 1))
                n, seq, m = 0, seq + 1, m - 1
            if m:
                stack.append((gap, seq, m))
    return matches, pieces, stack + [(-gap, seq, m) for gap, seq, m in shrunk]


def _sweeper(capacity: int, opened: int | None):
    """The sweep of one range of runs."""

    def run(batches):
        runs = [row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
        matches, pieces, gaps = sweep(runs, capacity, opened)
        rows = [(MATCH, size, first, n, per, seq, offset) for first, n, per, seq, offset, size in matches]
        rows += [(kind, size, first, n, None, None, None) for kind, left in ((PIECE, pieces), (GAP, gaps)) for size, first, n in left]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "size", "first", "n", "per", "seq", "offset"])

    return run


def match_runs(lengths: DataFrame, capacity: int) -> DataFrame:
    """The matches of all pieces, from the number of pieces (n) of each size: first, n, per, seq, offset and size."""
    longer = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each size: capacity at most
    lengths = staged(lengths.select("size", "n", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("before")), "pack-sizes")
    runs, ids = lengths.agg(F.count("*"), F.sum(F.col("size") * F.col("n"))).first()
    opened = -(-(ids or 0) // capacity)
    opens = F.greatest(F.lit(0).cast("long"), F.least("n", F.lit(opened) - F.col("before")))
    gaps = lengths.select(F.lit(GAP).alias("kind"), (F.lit(capacity) - F.col("size")).cast("int").alias("size"), F.col("before").alias("first"), opens.alias("n"))
    waiting = lengths.select(F.lit(PIECE).alias("kind"), "size", (F.col("before") + opens).alias("first"), (F.col("n") - opens).alias("n"))
    state = gaps.unionByName(waiting).where("n > 0 AND size > 0")
    # The piece with number k opens sequence k.
    matches = lengths.sparkSession.createDataFrame([(0, opened, 1, 0, 0, 0)] if opened else [], "first long, n long, per long, seq long, offset int, size int")
    ranges = max(1, -(-2 * runs // SWEEP_RUNS))
    while True:
        order = (F.desc("size"), "kind", "first")
        dealt = state.repartitionByRange(ranges, *order) if ranges > 1 else state.coalesce(1)
        swept = staged(dealt.sortWithinPartitions(*order).mapInArrow(_sweeper(capacity, opened if ranges == 1 else None), SWEPT), f"pack-swept-{ranges}")
        matches = matches.unionByName(swept.where(F.col("kind") == MATCH).drop("kind"))
        if ranges == 1:
            return matches
        state = swept.where(F.col("kind") != MATCH).select("kind", "size", "first", "n")
        ranges //= 2


def numbered(pieces: DataFrame, count: int) -> DataFrame:
    """row and number of every piece: from 0, the longest first."""
    order = (F.desc("length"), F.xxhash64("row"), "row")
    ranges = pieces.select("row", "length").repartitionByRange(max(1, -(-count // ORDER_ROWS)), *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = staged(ranges.select("row", F.spark_partition_id().alias("part"), within.alias("within")), "pack-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return dealt.join(starts, "part").select("row", (F.col("start") + F.col("within")).alias("number"))


def placed(numbers: DataFrame, matches: DataFrame) -> DataFrame:
    """row, sequence_id and offset: each number is in one interval of the matches. Intervals are cut at blocks of numbers, and go before the pieces there."""
    last = F.floor((F.col("first") + F.col("n") - 1) / BLOCK)
    cut = matches.select(F.explode(F.sequence(F.floor(F.col("first") / BLOCK), last)).alias("block"), F.struct("first", "per", "seq", "offset", "size").alias("match"))
    cut = cut.select("block", F.greatest("match.first", F.col("block") * BLOCK).alias("number"), F.lit(None).cast("long").alias("row"), "match")
    both = numbers.select(F.floor(F.col("number") / BLOCK).alias("block"), "number", "row", F.lit(None).cast(cut.schema["match"].dataType).alias("match")).unionByName(cut)
    in_block = Window.partitionBy("block").orderBy("number", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("number", "row", F.last("match", ignorenulls=True).over(in_block).alias("m")).where("row IS NOT NULL")
    at = F.col("number") - F.col("m.first")
    return found.select("row", (F.col("m.seq") + F.floor(at / F.col("m.per"))).alias("sequence_id"), (F.col("m.offset") + at % F.col("m.per") * F.col("m.size")).cast("long").alias("offset"))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (row, length and whatever else) with sequence_id and offset. pieces must be a written table."""
    lengths = pieces.groupBy(F.col("length").cast("int").alias("size")).agg(F.count("*").alias("n"))
    matches = match_runs(lengths, capacity)
    places = placed(numbered(pieces, pieces.count()), matches)
    return pieces.select(*[c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]).join(places, "row")


def pack_documents(docs: DataFrame, capacity: int = 4096, path: str | None = None, end: int = 1, id_col: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """The pieces of docs with their ids (if wanted; little-endian unsigned 32-bit), sequence_id and offset: a table in the shared folder."""
    spark = docs.sparkSession
    path = path or tokenizer_path("word_bpe_49k.json")
    with small_batches(spark):
        pieces = staged(cut_pieces(docs, capacity, path, end, id_col, text, with_ids), "pack-pieces", "zstd")
        out = pack(pieces, capacity).drop("row")
        out = staged(out.mapInArrow(_widened(id_type(path, end), out.columns.index("ids")), out.schema), "packed", "zstd")
    drop_staged(pieces)
    release(spark)
    return out
