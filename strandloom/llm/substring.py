"""Substring deduplication by content-defined chunking.

Words end where white space follows; a gear hash rolls over the bytes, and a
chunk ends with the first word whose gear value meets a mask, so cuts depend on
nearby content alone and an insertion moves none but its neighbours. Chunks of
more than MAX_BYTES are cut again at word ends counted from their own start. A
chunk's digest covers its words, with single spaces between them. A digest
belongs to the document with the smallest id that holds it; elsewhere, and at
later places of the same document, the chunk is a copy. Runs of copied chunks
that hold MIN_WORDS words or more are removed: a repeated passage of over 50
words loses at most the parts of a chunk at its two ends, and stays above the
bound; shorter repeats, such as set phrases, stay.

The digests of one document are made unique in the task that reads it; only the
smallest id of each digest is aggregated (with partial sums), and only digests
of two documents or more are joined back, so a hot passage is one row on one
side of a join whose other side can be split.

Defined results: null texts stay null with no chunks; empty texts stay empty. A text may be as long as
a string can be: it is hashed in blocks of bytes, though its chunks are in memory together.
Rows with a null id are left as they are. Rows with one id count as one
document: they don't remove each other's text. A text whose words are all
removed becomes empty. Repeated rows are returned as often as they stand. An
empty table gives an empty table. Other columns are kept; those named like an
output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm._shared import fresh, let_go, release, small_batches, staged

#: A chunk ends at one word in MEAN_WORDS, on average.
MEAN_WORDS = 5
MAX_BYTES = 80
#: Copied runs shorter than this stay.
MIN_WORDS = 18
#: Bytes that the gear hash looks back, and the blanks before each text, so that no text sees another.
LOOK_BACK = 16
_GAP = b" " * LOOK_BACK
BYTES_AT_ONCE = 1 << 20
#: Bits of a chunk's place in its text: a string has less than 2^31 bytes, a chunk and the blank behind it two at least.
PLACE_BITS = 30

_P = np.uint64(0x9E3779B97F4A7C15)
CHUNKS = "id long, spot long, digest long, again boolean"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = _mix(np.arange(1, 257, dtype=np.uint64))
WHITE_BYTES = b" \t\n\x0b\x0c\r"
_WHITE = np.zeros(256, bool)
_WHITE[list(WHITE_BYTES)] = True


def word_table(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the document it is in. edges: where documents start, and the end; white space must stand between them."""
    inside = ~_WHITE[raw]
    step = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return starts, ends, np.searchsorted(edges, starts, side="right") - 1


def _powers(base: int) -> np.ndarray:
    """Powers of base for the bytes of one block."""
    out = np.full(BYTES_AT_ONCE, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(int(_P)), _powers(pow(int(_P), -1, 1 << 64))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: differences of one running polynomial sum, brought to a common power. The sum runs over the bytes in blocks."""
    sums, back = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    before, up, down = np.uint64(0), 1, 1
    for low in range(0, len(raw), BYTES_AT_ONCE):
        part = raw[low : low + BYTES_AT_ONCE]
        running = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(GEAR[part] * _UP[: len(part)], out=running[1:])
        running = running * np.uint64(up) + before
        a, b = np.searchsorted(starts, (low, low + len(part)))
        sums[a:b] -= running[starts[a:b] - low]
        back[a:b] = _DOWN[starts[a:b] - low] * np.uint64(down)
        a, b = np.searchsorted(ends, (low, low + len(part)), side="right")  # an end is past its word's last byte
        sums[a:b] += running[ends[a:b] - low]
        before = running[-1]
        up, down = up * int(_UP[-1]) * int(_P) % (1 << 64), down * int(_DOWN[-1]) * int(_DOWN[1]) % (1 << 64)
    return _mix(sums * back + (ends - starts).astype(np.uint64))


def gear(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gear hash after the bytes at these places, over the LOOK_BACK bytes up to each: windows are doubled instead of a loop."""
    out = np.zeros(len(at), np.uint32)
    for low in range(0, len(raw), BYTES_AT_ONCE):
        a, b = np.searchsorted(at, (low, low + BYTES_AT_ONCE))
        from_here = max(0, low - LOOK_BACK)
        h, w = GEAR[raw[from_here : low + BYTES_AT_ONCE]].astype(np.uint32), 1
        while w < LOOK_BACK:
            wider = h.copy()
            wider[w:] += h[:-w] << np.uint32(w)
            h, w = wider, 2 * w
        out[a:b] = h[at[a:b] - from_here]
    return out


def chunks_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The chunks of all texts in order: doc, place (chunk number in its document), digest, words, and first and last byte in the text."""
    raw = np.frombuffer(_GAP + _GAP.join(texts) + _GAP, np.uint8)
    sizes = np.array([len(t) + LOOK_BACK for t in texts], np.int64)
    edges = LOOK_BACK + np.concatenate([[0], np.cumsum(sizes)])
    starts, ends, docs = word_table(raw, edges)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return {k: none for k in ("doc", "place", "digest", "words", "first", "last")}
    value = (gear(raw, ends - 1).astype(np.uint64) * np.uint64(MEAN_WORDS)) >> np.uint64(32)
    new_doc = np.concatenate([[True], docs[1:] != docs[:-1]])
    cut_before = new_doc.copy()
    cut_before[1:] |= value[:-1] == 0
    # Long chunks: another cut wherever a multiple of MAX_BYTES from the chunk's start is passed.
    chunk_start = starts[np.flatnonzero(cut_before)][np.cumsum(cut_before) - 1]
    step = (ends - chunk_start) // MAX_BYTES
    cut_before[1:] |= step[1:] != step[:-1]
    first = np.flatnonzero(cut_before)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    hashes = word_hashes(raw, starts, ends)
    of_chunk = np.cumsum(cut_before) - 1
    within = np.arange(len(starts)) - first[of_chunk]
    digest = np.add.reduceat(_mix(hashes + within.astype(np.uint64) * _P), first)
    doc = docs[first]
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    place = np.arange(len(doc)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(doc)]])))
    return {"doc": doc, "place": place, "digest": _mix(digest).view(np.int64), "words": last - first + 1, "first": starts[first] - edges[doc], "last": ends[last] - edges[doc]}


def slices(batches, text_at: int):
    """Parts of batches with their texts as bytes, BYTES_AT_ONCE at a time or one text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + BYTES_AT_ONCE)))
            part = batch.slice(low, high - low)
            yield part, [t or b"" for t in part.column(text_at).cast(pa.binary()).to_pylist()]
            low = high
        let_go()


def _spots(text_hash: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A chunk's place in its text (PLACE_BITS) with the leading bits of the text's hash, which tell apart texts of one id."""
    return (text_hash & ~np.int64((1 << PLACE_BITS) - 1)) | place


def _emit(batches):
    for batch, texts in slices(batches, 2):
        found = chunks_of(texts)
        doc, digest, place = found["doc"], found["digest"], found["place"]
        # Within a document only the first of equal digests is looked up; the others are copies already.
        order = np.lexsort((place, digest, doc))
        same = np.concatenate([[False], (doc[order][1:] == doc[order][:-1]) & (digest[order][1:] == digest[order][:-1])])
        again = np.zeros(len(doc), bool)
        again[order] = same[: len(doc)]
        ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False)[doc] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_spots(hashes, place)), pa.array(digest), pa.array(again)], names=["id", "spot", "digest", "again"])


def cut_runs(text: bytes, found: dict[str, np.ndarray], a: int, b: int, places: list[int], min_words: int) -> tuple[bytes, list[tuple[int, int]]]:
    """text without its runs of copied chunks of min_words or more, and the bytes taken out. Its chunks are those from a to b."""
    copied = np.zeros(b - a, np.int8)
    copied[places] = 1
    step = np.diff(np.concatenate([[0], copied, [0]]))
    words = np.concatenate([[0], np.cumsum(found["words"][a:b])])
    runs = zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)
    spans = [(int(found["first"][a + i]), int(found["last"][a + j - 1])) for i, j in runs if words[j] - words[i] >= min_words]
    kept, at = [], 0
    for i, j in spans:
        kept.append(text[at:i])
        at = j
    new = b"".join([*kept, text[at:]])
    return (b"" if spans and not new.strip(WHITE_BYTES) else new), spans


def _cutter(fields: int, text_at: int, min_words: int):
    """Rows with the runs of copied chunks taken out of their texts. The column past the fields holds the places of copied chunks; rows without any pass as they are."""

    def run(batches):
        for batch, texts in slices(batches, text_at):
            marks = batch.column(fields).to_pylist()
            new: list[str | None] = batch.column(text_at).to_pylist()
            spans_out: list[list[dict]] = [[] for _ in texts]
            hit = [k for k, m in enumerate(marks) if m]
            found = chunks_of([texts[k] for k in hit])
            bounds = np.searchsorted(found["doc"], np.arange(len(hit) + 1))
            for n, k in enumerate(hit):
                cut, spans = cut_runs(texts[k], found, int(bounds[n]), int(bounds[n + 1]), marks[k], min_words)
                new[k] = cut.decode("utf-8")
                spans_out[k] = [{"start": i, "stop": j} for i, j in spans]
            cols = [batch.column(c) for c in range(fields)]
            cols[text_at] = pa.array(new, pa.string())
            removed = [sum(x["stop"] - x["start"] for x in spans) for spans in spans_out]
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            extra = [pa.array([len(m or ()) for m in marks], pa.int32()), pa.array(removed, pa.int64()), pa.array(spans_out, span)]
            yield pa.RecordBatch.from_arrays([*cols, *extra], names=[*batch.schema.names[:fields], "n_copied", "removed_bytes", "removed_spans"])

    return run


def copied_chunks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, text_key (leading bits of the text's hash) and the places of the chunks that are copies; documents without any are absent."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        chunks = staged(rows.mapInArrow(_emit, CHUNKS), "chunks")
    looked_up = chunks.where(~F.col("again"))
    owners = looked_up.groupBy("digest").agg(F.min("id").alias("owner"), F.max("id").alias("other")).where(F.col("owner") < F.col("other")).select("digest", "owner")
    owners = staged(owners, "chunk-owners")
    release(docs.sparkSession)
    elsewhere = looked_up.join(owners, "digest").where(F.col("id") != F.col("owner")).select("id", "spot")
    copies = chunks.where("again").select("id", "spot").unionByName(elsewhere)
    place = F.col("spot").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    marked = copies.select("id", F.shiftright("spot", PLACE_BITS).alias("text_key"), place.cast("int").alias("place"))
    out = staged(marked.groupBy("id", "text_key").agg(F.collect_set("place").alias("places")), "copied")  # the chunks of one text
    del chunks, looked_up, owners, elsewhere, copies, marked
    release(docs.sparkSession)
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the copied passages taken out of the text, and n_copied (chunks), removed_bytes and removed_spans (bytes of the text as it was)."""
    keep = [c for c in docs.columns if c.lower() not in ("n_copied", "removed_bytes", "removed_spans")]
    docs = docs.select(*keep)
    key, places, owner = fresh(docs, "text_key_", "places_", "id_")
    marks = copied_chunks(docs, id_col, text).toDF(owner, key + "_", places)
    rows = docs.select("*", F.shiftright(F.xxhash64(text), PLACE_BITS).alias(key))
    joined = rows.join(marks, (rows[id_col].cast("long") == marks[owner]) & (rows[key] == marks[key + "_"]), "left").select(*[rows[c] for c in keep], places)
    extra = T.StructType.fromDDL("n_copied int, removed_bytes long, removed_spans array<struct<start: long, stop: long>>")
    return joined.mapInArrow(_cutter(len(keep), keep.index(text), min_words), T.StructType([*docs.schema, *extra]))
