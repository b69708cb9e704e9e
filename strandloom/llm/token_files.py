"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (0: most frequent), so common
tokens take one byte. Four ranks share a control byte, two bits each for a
length of one to four bytes; control bytes and data bytes are stored apart.
Decoding reads the control bytes through a table of 256 entries and gathers the
data with numpy: no loop over ids.

A token file set is a folder with two Parquet tables, written by Spark so that
any store holds it: vocab (rank, id) and blocks. Documents are
range-partitioned by doc_id, into ranges whose number follows from the size of the input; a range is a folder part=0, part=1
and so on of blocks, so the folders are in ascending order of documents. A block holds whole documents in
ascending doc_id order: first (ids of all blocks before, by which the blocks of a folder stand in order too), doc_ids,
lengths (ids of each document), n (ids in all), control and data. Blocks are cut at BLOCK_IDS ids, and a longer
document is a block of its own.

Defined results: very long texts are encoded whole; a null text is an empty one and has the end id alone; null
doc_ids come first; rows with equal doc_ids keep the order of the input, and
repeated rows are encoded as often as they stand. An empty table gives an
empty file set. Only the id and the text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm._shared import estimated_bytes, new_folder, small_batches, staged
from strandloom.llm.tokens import encoded, tokenizer_path

BLOCK_IDS = 1 << 19
#: Words that a worker keeps: more than by default, since encoding is most of the work.
KEPT_WORDS = 800_000
#: Bytes of the input, as Spark estimates them, in a range.
RANGE_BYTES = 128 << 20
BLOCKS = "part int, first long, doc_ids array<long>, lengths array<long>, n long, control binary, data binary"

#: Of each control byte: the lengths of its four ranks, and where each starts.
_LENGTHS = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3) + 1
_OFFSETS = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
_TOTALS = _LENGTHS.sum(axis=1)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of whole numbers below 2^32. The last four are filled up with zeros."""
    n = len(ranks)
    full = np.zeros(-(-n // 4) * 4, np.uint32)
    full[:n] = ranks
    code, width, most = np.zeros(len(full), np.uint8), 1, int(full.max(initial=0))
    while width < 4 and most >= 1 << (8 * width):
        code += full >= 1 << (8 * width)
        width += 1
    a, b, c, d = (code[k::4] for k in range(4))
    control = a | (b << 2) | (c << 4) | (d << 6)
    # Only as many byte columns as the largest number needs.
    columns = full.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return control.tobytes(), columns[np.arange(width, dtype=np.uint8) <= code[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers behind encode_ranks."""
    codes = np.frombuffer(control, np.uint8)
    if not len(codes):
        return np.zeros(0, np.uint32)
    totals = _TOTALS[codes]
    at = ((np.cumsum(totals) - totals)[:, None] + _OFFSETS[codes]).reshape(-1)[:n]
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = padded[at].astype(np.uint32)
    lengths = _LENGTHS[codes].reshape(-1)[:n]
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        words[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return words


def _tokenise(path: str, end: int):
    """doc_id, its ids with the end id, the task's partition, and the ids before in it; last a row (n -1) with the occurrences of each id in the task."""
    names = ["doc_id", "ids", "n", "part", "width", "before", "counts"]

    def run(batches):
        part, before, total = TaskContext.get().partitionId(), 0, np.zeros(1, np.int64)
        for batch, ids, sizes in encoded(batches, path, 1, most=KEPT_WORDS):
            ends = np.cumsum(sizes + 1)
            full = np.full(int(ends[-1]), end, np.int32)
            mask = np.ones(len(full), bool)
            mask[ends - 1] = False
            full[mask] = ids
            total = _added(total, np.bincount(full))
            small = full.astype("<u2") if int(full.max()) < 1 << 16 else full.astype("<u4")
            width = small.itemsize
            offsets = pa.py_buffer(np.concatenate([[0], ends * width]).astype(np.int32))
            blob = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(small.tobytes())])
            n = len(sizes)
            starts = before + ends - sizes - 1
            before += len(full)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), blob, pa.array(sizes + 1, pa.int64()), pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, width), pa.int32()), pa.array(starts, pa.int64()), pa.nulls(n, pa.binary())],
                names=names,
            )
        last = [(None, pa.int64()), (None, pa.binary()), (-1, pa.int64()), (part, pa.int32()), (0, pa.int32()), (0, pa.int64()), (total.tobytes(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in last], names=names)

    return run


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two count arrays; the shorter one goes on with zeros."""
    short, long = (a, b.copy()) if len(a) < len(b) else (b, a)
    long[: len(short)] += short
    return long


def _counts(batches):
    """Occurrences of each id over the counts of some tasks."""
    total = np.zeros(1, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            total = _added(total, np.frombuffer(blob, np.int64))
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["id", "n"])


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end: int = 2, id_col: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """The file set of docs in folder. path: a vocabulary file of the tokenizers library."""
    spark = docs.sparkSession
    path = path or tokenizer_path("word_bpe_49k.json")
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(docs.select(id_col, text)) // RANGE_BYTES))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("at"))
    ordered = narrow.repartitionByRange(parts, "doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")
    with small_batches(spark):
        tokens = staged(ordered.mapInArrow(_tokenise(path, end), "doc_id long, ids binary, n long, part int, width int, before long, counts binary"), "token-ids", "zstd")
    # Ranks: at most one row for each entry of the vocabulary.
    counts = tokens.where("counts is not null").select("counts").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r[0] for r in counts.orderBy(F.desc("n"), "id").select("id").collect()]
    spark.createDataFrame([(k, i) for k, i in enumerate(ranked)], "rank int, id int").coalesce(1).write.parquet(f"{folder}/vocab")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    # Where each range starts: one row for each partition.
    totals = sorted((r[0], r[1]) for r in tokens.where("n >= 0").groupBy("part").agg(F.sum("n")).collect())
    firsts, before = {}, 0
    for part, n in totals:
        firsts[part], before = before, before + n

    def block_up(batches):
        """Blocks of consecutive rows. A new one starts where a part, or the part of a file that the task reads, does."""
        held: list[tuple[int | None, np.ndarray]] = []
        at, first, size = 0, 0, 0

        def flush():
            nonlocal held, size
            ids = np.concatenate([x for _, x in held])
            control, data = encode_ranks(rank_of[ids])
            row = [[at], [first], [[d for d, _ in held]], [[len(x) for _, x in held]], [len(ids)], [control], [data]]
            held, size = [], 0
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "first", "doc_ids", "lengths", "n", "control", "data"])

        for batch in batches:
            for doc, blob, part, width, before in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                ids = np.frombuffer(blob, "<u2" if width == 2 else "<u4")
                start = firsts[part] + before
                if held and (part != at or start != first + size or size + len(ids) > BLOCK_IDS):
                    yield flush()
                if not held:
                    at, first = part, start
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield flush()

    blocks = tokens.where("n >= 0").select("doc_id", "ids", "part", "width", "before").mapInArrow(block_up, BLOCKS)
    blocks.write.option("compression", "uncompressed").partitionBy("part").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit; null unless wanted) and their crc32."""
    vocab = spark.read.schema("rank int, id int").parquet(f"{folder}/vocab").orderBy("rank").select("id")
    ids_of = np.array([r[0] for r in vocab.collect()], np.uint32)  # the vocabulary at most

    def decode(batches):
        for batch in batches:
            for first, docs, lengths, n, control, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                ids = ids_of[decode_ranks(control, data, n)].astype("<u4")
                sizes = np.array(lengths, np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                cuts = zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True)
                blobs = [raw[a:b] for a, b in cuts]
                kept = pa.array([bytes(b) for b in blobs] if with_ids else [None] * len(blobs), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes), kept, pa.array([zlib.crc32(b) for b in blobs], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select("first", "doc_ids", "lengths", "n", "control", "data")
    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    return new_folder(spark, "token-files")
