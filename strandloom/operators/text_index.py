"""A trigram index for `ILIKE '%x%'` and regular expressions.

A text that matches a pattern holds the trigrams of the pattern's literal runs. The index keeps, for each trigram of lower-case ASCII characters and each bucket of rows, the ids
that hold it; buckets have about BUCKET_ROWS rows, so no list is longer, whatever a trigram's frequency. Texts are shuffled once, into the order of their buckets, and each task makes the lists of the
buckets that it reads, so lists are never shuffled; where two tasks share a bucket, or one holds more than RUN_PAIRS pairs, its lists come in parts, which a search puts together. A pattern is compiled to a tree of
and / or over trigrams; of the trigrams that must all be there the rarest ones are looked up. In each bucket the lists are intersected and joined to candidates, and the
candidates' texts, and no others, are tested with the pattern itself, so results equal those of a scan. Texts are stored in order of buckets, so a search reads the row groups of its candidates'
buckets.

A pattern that demands no trigram (shorter ones, `a.*b`, an optional part, a branch without one, flags for Unicode case) is tested on all texts: the answer is the same.
Null texts match nothing; rows with a null id are left out; rows that share an id are found each for itself.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.staging import new_place

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    from re import _constants as C
    from re import _parser as P

#: Rows in a bucket, about; trigrams of an `and` that are looked up; buckets that are named in a scan's filter (more are joined only).
BUCKET_ROWS, LOOKED_UP, NAMED_BUCKETS = 4096, 4, 1000
#: Pairs of a trigram and a row that a task gathers before it writes their lists, and bytes of text that it cuts into trigrams at once.
RUN_PAIRS, PIECE_BYTES = 2 << 20, 1 << 20
#: Alternatives of a set of characters that are spelled out.
SPELLED = 4
#: Java's patterns that Python's parser reads otherwise, or not at all.
_FOREIGN = re.compile(r"\\[QEGpPXRhHNK]|\(\?[a-zA-Z]*u|\(\?<[^=!]|\(\?>|[*+?}]\+|&&|\\x\{|\[[^\]]*\[|\(\?x|\(\?[a-zA-Z]*[xd]")

_POSTINGS = "gram string, bucket int, ids array<long>"


@dataclass(frozen=True)
class Need:
    """What a text must hold. kind: gram (of), all, any (parts), or nothing (no demand)."""

    kind: str
    of: str = ""
    parts: tuple[Need, ...] = ()


NOTHING = Need("nothing")


def _all(parts: list[Need]) -> Need:
    flat = dict.fromkeys(q for p in parts if p.kind != "nothing" for q in (p.parts if p.kind == "all" else (p,)))
    return NOTHING if not flat else next(iter(flat)) if len(flat) == 1 else Need("all", parts=tuple(flat))


def _any(parts: list[Need]) -> Need:
    if any(p.kind == "nothing" for p in parts) or not parts:
        return NOTHING
    flat = dict.fromkeys(q for p in parts for q in (p.parts if p.kind == "any" else (p,)))
    return next(iter(flat)) if len(flat) == 1 else Need("any", parts=tuple(flat))


def need_of_literal(text: str) -> Need:
    """The trigrams of a literal run. A character that isn't ASCII ends a run."""
    grams = []
    for run in re.findall(r"[\x00-\x7f]+", text):
        low = run.lower()
        grams += [Need("gram", low[k : k + 3]) for k in range(len(low) - 2)]
    return _all(grams)


def _walk(items) -> Need:
    """What a sequence of a parsed pattern demands. Literals next to each other make runs, in each of their spellings."""
    needs: list[Need] = []
    runs = [""]

    def end():
        nonlocal runs
        needs.append(_any([need_of_literal(r) for r in runs]))
        runs = [""]

    for op, value in items:
        if op is C.LITERAL:
            runs = [r + chr(value) for r in runs]
        elif op is C.IN and (letters := _letters(value)) and len(runs) * len(letters) <= SPELLED:
            runs = [r + x for r in runs for x in letters]
        elif op is C.SUBPATTERN:
            inner = value[-1]
            if all(o is C.LITERAL for o, _ in inner):
                runs = [r + "".join(chr(v) for _, v in inner) for r in runs]
            else:
                end()
                needs.append(_walk(inner))
        elif op is C.BRANCH:
            end()
            needs.append(_any([_walk(b) for b in value[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)):
            end()
            if value[0] > 0:
                needs.append(_walk(value[2]))
        elif op is C.AT:
            continue  # places hold no characters
        else:
            end()  # any character, a class, a look-around, a back reference
    end()
    return _all(needs)


def _letters(value) -> list[str]:
    return [chr(v) for _, v in value] if all(o is C.LITERAL for o, _ in value) else []


def need_of_pattern(pattern: str) -> Need:
    """What texts must hold to match a regular expression; nothing if that can't be told."""
    if _FOREIGN.search(pattern):
        return NOTHING
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _walk(P.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return NOTHING


def grams_of(need: Need) -> set[str]:
    return {need.of} if need.kind == "gram" else {g for p in need.parts for g in grams_of(p)}


def rarest(need: Need, counts: dict[str, int], most: int = LOOKED_UP) -> Need:
    """The need with the rarest parts of each `and`, the rarest first. A trigram that no text holds makes all others unnecessary."""
    if need.kind in ("gram", "nothing"):
        return need
    parts = [rarest(p, counts, most) for p in need.parts]
    if need.kind == "any":
        return _any(parts)
    parts.sort(key=lambda p: sum(counts.get(g, 0) for g in grams_of(p)))
    kept = parts[:most]
    return kept[0] if len(kept) == 1 else Need("all", parts=tuple(kept))


def _candidates(need: Need, lists: Column) -> Column:
    """The ids of a bucket that hold what is needed, from its lists by trigram."""
    none = F.array().cast("array<long>")
    if need.kind == "gram":
        return F.coalesce(F.try_element_at(lists, F.lit(need.of)), none)
    out = _candidates(need.parts[0], lists)
    for p in need.parts[1:]:
        out = (F.array_intersect if need.kind == "all" else F.array_union)(out, _candidates(p, lists))
    return out


@dataclass
class TextIndex:
    postings: DataFrame  # gram, bucket, ids
    counts: DataFrame  # gram, n
    texts: DataFrame  # bucket, id, text
    buckets: int

    def needed(self, need: Need) -> Need:
        grams = sorted(grams_of(need))
        found = {r["gram"]: r["n"] for r in self.counts.where(F.col("gram").isin(grams)).collect()}  # as many as the pattern has
        return rarest(need, found)

    def candidates(self, need: Need) -> DataFrame | None:
        """bucket and id of the rows that may match; None for all of them."""
        if need.kind == "nothing":
            return None
        need = self.needed(need)
        some = self.postings.where(F.col("gram").isin(sorted(grams_of(need))))
        some = some.groupBy("bucket", "gram").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))  # parts of a list
        lists = some.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))  # a few lists of a bucket
        return lists.select("bucket", F.explode(_candidates(need, F.col("lists"))).alias("id"))

    def _tested(self, need: Need, test: Column) -> DataFrame:
        found = self.candidates(need)
        if found is None:
            return self.texts.where(test).select("id", "text")
        named = [r[0] for r in found.select("bucket").distinct().limit(NAMED_BUCKETS + 1).collect()]
        texts = self.texts.where(F.col("bucket").isin(named)) if len(named) <= NAMED_BUCKETS else self.texts
        return texts.join(found, ["bucket", "id"], "left_semi").where(test).select("id", "text")

    def contains(self, word: str) -> DataFrame:
        """id and text of the rows whose text holds a word, whatever the case of either."""
        plain = re.sub(r"([\\%_])", r"\\\1", word)
        return self._tested(need_of_literal(word), F.ilike(F.col("text"), F.lit(f"%{plain}%")))

    def matching(self, pattern: str, ignore_case: bool = False) -> DataFrame:
        """id and text of the rows that a regular expression matches somewhere."""
        return self._tested(need_of_pattern(pattern), F.rlike(F.col("text"), F.lit(f"(?i){pattern}" if ignore_case else pattern)))


def _codes(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (in starts) and codes of the distinct trigrams of ASCII characters of each text, in order. text: the bytes of all of them; starts: where each begins, and the end."""
    if len(text) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = text.astype(np.int64)
    at = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    fine = ((x[:-2] | x[1:-1] | x[2:]) < 128) & (at[:-2] == at[2:])  # bytes of other characters are 128 or more
    found = np.unique((at[:-2] << 21 | x[:-2] << 14 | x[1:-1] << 7 | x[2:])[fine])
    return found >> 21, found & ((1 << 21) - 1)


def _pieces(texts: pa.Array):
    """Bounds of the rows that are cut into trigrams at once, with their bytes and where each row begins in them; a longer text by itself, in overlapping parts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        first, last = offsets[row], offsets[end]
        if last - first <= PIECE_BYTES:
            yield row, data[first:last], offsets[row : end + 1] - first
        else:
            for begin in range(first, last - 2, PIECE_BYTES):
                part = data[begin : min(begin + PIECE_BYTES + 2, last)]
                yield row, part, np.array([0, len(part)])
        row = end


def _lists(batches):
    """Lists of the ids of each trigram and bucket, from rows of bucket, id and lower-case text in order of buckets and ids."""
    now, ids, codes, held = None, [], [], 0

    def run():
        row, code = np.concatenate(ids), np.concatenate(codes)
        order = np.lexsort((row, code))
        row, code = row[order], code[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])  # rows that share an id, parts of a text
        row, code = row[new], code[new]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        gram = code[first]
        spelled = np.stack([gram >> 14, gram >> 7 & 127, gram & 127], axis=1).astype(np.uint8).tobytes()
        grams = pa.StringArray.from_buffers(len(gram), pa.py_buffer(np.arange(0, 3 * len(gram) + 1, 3, dtype=np.int32)), pa.py_buffer(spelled))
        return pa.RecordBatch.from_arrays([grams, pa.array(np.full(len(gram), now, np.int32)), pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(row))], names=["gram", "bucket", "ids"])

    for batch in batches:
        bucket, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if held and bucket[start] != now:
                yield run()
                ids, codes, held = [], [], 0
            now = int(bucket[start])
            for row, text, starts in _pieces(batch.column(2).slice(start, end - start).cast(pa.string())):
                place, code = _codes(text, starts)
                if not len(code):
                    continue
                ids.append(key[start + row + place])
                codes.append(code.astype(np.int32))
                held += len(code)
                if held >= RUN_PAIRS:
                    yield run()
                    ids, codes, held = [], [], 0
    if held:
        yield run()


def build(df: DataFrame, key: str, text: str, folder: str | None = None) -> TextIndex:
    """An index of all texts of df in a folder (one of its own if none is given)."""
    spark, folder = df.sparkSession, folder or new_place(df.sparkSession, "text-index")
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    buckets = max(1, rows.count() // BUCKET_ROWS)
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), "id", "text")
    rows.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id").write.parquet(f"{folder}/texts")
    texts = spark.read.schema(rows.schema).parquet(f"{folder}/texts")
    lists = texts.select("bucket", "id", F.lower("text").alias("text")).mapInArrow(_lists, _POSTINGS)
    lists.sortWithinPartitions("gram", "bucket").write.parquet(f"{folder}/postings")
    postings = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings")
    counts = postings.groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/counts")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/about")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> TextIndex:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    return TextIndex(read("postings", _POSTINGS), read("counts", "gram string, n long"), read("texts", "bucket int, id long, text string"), read("about", "buckets int").first()[0])
