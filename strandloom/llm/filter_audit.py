"""How filters interact: what each removes, alone and after others, in all orders.

Every text is tested once, so all 120 orders follow from how often each set of failed filters (a mask of five
bits) occurs in a part of the documents: 32 counts of documents, of good and of toxic ones.

Copies are found by a fingerprint-routed RDD. A row goes to the partition that the xxhash of its text
names. There the rows of one fingerprint come one after another, by id; a chain of its different texts, in full, with the
least id of each, tells copies from collisions, and rows beyond the least id fail. Only one chain is held at a time. Each task first does the same for the texts
that it has read, as far as HELD_BYTES allow: of the copies in a task only those with its least id travel with their
text, so a text that a third of all rows share becomes about one row for each task. Vectors of counts by mask are merged by
combineByKey, first in each task.

Defined results: a null text is an empty one; texts may be as long as a string can be. A null id is no id: such a row is never a copy by id, makes
no other row one, and has no labels. Rows that share the least id of a text are all kept by the filter of copies. A document is good, or toxic, if any of its rows in
the labels says 1; null labels say nothing. A null source is the empty string's part. An empty table has no parts and
gives an empty result. Only the id, text, source and label columns are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: The bit of each filter in a mask.
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
COPY = BIT["E"]
MIN_WORDS = 200
#: Bytes of different texts that a task holds while it reads.
HELD_BYTES = 32 << 20
#: Bytes of texts in each partition that they are routed to, about.
PARTITION_BYTES = 64 << 20
#: Null ids of one side of the join with labels are dealt out by so many numbers.
SALTS = 1024

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
COUNTS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def mask_of(text: str, raw: bytes) -> int:
    """The filters A to D that a text fails. Bytes are split at ASCII white space."""
    words = raw.split()
    n = len(words)
    out = BIT["A"] * (n < MIN_WORDS) | BIT["B"] * (100 * len(set(words)) < 50 * n)
    out |= BIT["C"] * (100 * (len(raw) - len(raw.translate(None, _UPPER))) > 2 * len(text))
    return out | BIT["D"] * (len(raw.translate(None, _SYMBOLS)) < len(raw))


def _read(rows: Iterator) -> Iterator:
    """((fingerprint, id), (id, rows by source, mask, text)). Of each text that this task holds, the rows with the least id come with the text; rows that are known to be copies, and rows without an id, come without one and with a fingerprint that spreads them."""
    held: dict[bytes, list] = {}
    size = alone = 0

    def decided(doc, sources, mask):
        nonlocal alone
        alone += 1
        return (xxhash.xxh3_64_intdigest(alone.to_bytes(8, "little")) >> 1, 0), (doc, sources, mask, None)

    def flush():
        for raw, (doc, sources, mask) in held.items():
            yield (xxhash.xxh3_64_intdigest(raw) >> 1, doc), (doc, sources, mask, raw)
        held.clear()

    for doc, text, source in rows:
        text, source = text or "", source or ""
        raw = text.encode("utf-8")
        known = held.get(raw)
        if doc is None:
            yield decided(None, {source: 1}, known[2] if known else mask_of(text, raw))
        elif known is None:
            held[raw] = [doc, {source: 1}, mask_of(text, raw)]
            size += len(raw) + 200
        elif doc == known[0]:
            known[1][source] = known[1].get(source, 0) + 1
        elif doc > known[0]:
            yield decided(doc, {source: 1}, known[2] | COPY)
        else:
            yield decided(known[0], known[1], known[2] | COPY)
            held[raw] = [doc, {source: 1}, known[2]]
        if size > HELD_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def _copies(rows: Iterator) -> Iterator:
    """(id, source, mask, number of rows) from a partition that comes in order of fingerprint and id."""
    mark, chain = None, {}
    for (now, _), (doc, sources, mask, raw) in rows:
        if raw is not None:
            if now != mark:
                mark, chain = now, {}
            if chain.setdefault(raw, doc) != doc:
                mask |= COPY
        for source, n in sources.items():
            yield doc, source, mask, n


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, part, mask and n: so many rows fail these filters, copies in all of docs included."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long"), F.col(text), F.col(source).cast("string"))
    read = rows.rdd.mapPartitions(_read)
    # Texts decide how many partitions there are, and Spark's estimate knows files at most, which are compressed.
    size = rows.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = max(size // PARTITION_BYTES, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = read.repartitionAndSortWithinPartitions(parts, lambda key: key[0])
    return spark.createDataFrame(routed.mapPartitions(_copies), "id long, part string, mask int, n long", verifySchema=False)


def _vector(value: tuple) -> np.ndarray:
    return _add(np.zeros((3, 1 << len(FILTERS)), np.int64), value)


def _add(held: np.ndarray, value: tuple) -> np.ndarray:
    mask, n, good, toxic = value
    held[:, mask] += n, n * good, n * toxic
    return held


def in_all_orders(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of COUNTS of one part from its counts by mask (all, good, toxic)."""
    masks = np.arange(counts.shape[1])
    removed = {}
    for order in permutations(FILTERS):
        before = 0
        for name in order:
            bit = BIT[name]
            removed[order, name] = ((masks & before) == 0) & ((masks & bit) > 0), before
            before |= bit
    shapley = {name: sum(int(counts[0, removed[order, name][0]].sum()) for order in permutations(FILTERS)) for name in FILTERS}
    for order in permutations(FILTERS):
        for step, name in enumerate(order, 1):
            at, before = removed[order, name]
            bit = BIT[name]
            kept = counts[0, (masks & (before | bit)) == 0].sum()
            redundant = counts[0, ((masks & bit) > 0) & ((masks & before) > 0)].sum()
            yield part, "".join(order), step, int(kept), int(counts[0, at].sum()), int(redundant), int(counts[0, bit]), int(counts[1, at].sum()), int(counts[2, at].sum()), shapley[name]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """For each part, order of filters and step: the counts of COUNTS."""
    spark = docs.sparkSession
    said = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int"))
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    failed = failed_filters(docs, id_col, text, source).withColumn("salt", F.when(F.col("id").isNull(), F.monotonically_increasing_id() % SALTS).otherwise(0))
    marked = marked.withColumn("label_salt", F.lit(0).cast("long"))
    rows = failed.join(marked, (F.col("id") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")), "left")
    rows = rows.select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    pairs = rows.rdd.map(lambda r: (r[0], tuple(r[1:])))
    counted = pairs.combineByKey(_vector, _add, lambda a, b: a + b)
    return spark.createDataFrame(counted.flatMap(lambda x: in_all_orders(*x)), COUNTS, verifySchema=False)
