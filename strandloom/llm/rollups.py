"""Token counts as delta-maintained rollups.

A store is a folder in which every committed batch has a table of signed sums by
source, language and tokenizer version: documents and tokens that an insert adds,
a delete takes away, and a revision changes. Totals are additive, so they are the
sum over all batches; nothing is recounted. A batch is written to a folder of its own
and counts once a marker under its name says so and which folder it is; the marker comes into place whole, where nothing stands, so of two writers of
one name the first counts, committing a name again changes
nothing, and a batch whose writer died before the marker is written anew. compact()
folds the batches of one listing into a snapshot that names just these, in the same way; what it folds stays until the next
compaction, for readers that began before.

Tokenizer versions are either vocabulary files of the tokenizers library (VOCABULARIES), whose tokens are counted by encoding
whole texts, or patterns (PATTERNS), counted by a column expression.

Changes are rows of op (insert, delete or revise), source, lang, tokenizer and
n_tokens; revise also has old_source, old_lang, old_tokenizer and
old_n_tokens. Signed rows are summed within each task before they move, so a
source with a third of all rows costs one row a task.

Defined results: null texts have no tokens; empty and very long ones are texts like others. Null source, lang and tokenizer are groups of their own; a null
count is 0; groups whose documents and tokens are both 0 leave the totals. A
store without batches has empty totals. Repeated change rows count as often as
they stand. An unknown op raises an error when the batch is committed.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm._shared import WORD, delete_path, path_exists, small_batches
from strandloom.llm.tokens import encoded, tokenizer_path

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizer versions that need no vocabulary: patterns whose matches are the tokens.
PATTERNS = {"words-1": WORD, "pieces-1": r"[A-Za-z]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9]+"}
#: Tokenizer versions by their vocabulary file.
VOCABULARIES = {"word-bpe-49k": "word_bpe_49k.json"}


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens in a text under one of PATTERNS; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[tokenizer])).cast("long"), F.lit(0).cast("long"))


def with_counts(docs: DataFrame, wanted: list[tuple[str, str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """source, lang, the columns to keep, and for each (text column, tokenizer, name) a column of that name with the tokens of the text."""
    columns = [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *keep]
    columns += [(F.col(text) if kind in VOCABULARIES else count_tokens(F.col(text), kind)).alias(name) for text, kind, name in wanted]
    rows = docs.select(*columns)
    for k, (_, kind, name) in enumerate(wanted):
        if kind in VOCABULARIES:
            names = rows.columns
            schema = ", ".join(f"{c} {'long' if c == name else t}" for c, t in rows.dtypes)
            rows = rows.mapInArrow(_counter(tokenizer_path(VOCABULARIES[kind]), 2 + len(keep) + k, names), schema)
    return rows


def _counter(path: str, at: int, names: list[str]):
    """Texts at a place replaced by the numbers of their tokens."""

    def run(batches):
        for part, _, sizes in encoded(batches, path, at):
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()) if k == at else part.column(k) for k in range(len(names))], names=names)

    return run


def changes(docs: DataFrame, op: str, tokenizer: str, text: str = "text", old: tuple[str, str] | None = None) -> DataFrame:
    """Change rows for docs. old, for revise: the text column and tokenizer that were counted before."""
    counted = with_counts(docs, [(text, tokenizer, "n_tokens"), *([(*old, "old_n_tokens")] if old else [])])
    rows = counted.select(F.lit(op).alias("op"), "*", F.lit(tokenizer).alias("tokenizer"))
    if old:
        rows = rows.select("*", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(old[1]).alias("old_tokenizer"))
    return rows


def counted_changes(counted: DataFrame, op: str, tokenizer: str, tokens: str, old: tuple[str, str] | None = None) -> DataFrame:
    """Change rows from a table of counts (source, lang and columns of with_counts), so texts are counted once for many batches. old, for revise: the column and tokenizer that counted before."""
    columns = [F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(tokens).alias("n_tokens")]
    if old:
        columns += [F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(old[1]).alias("old_tokenizer"), F.col(old[0]).alias("old_n_tokens")]
    return counted.select(*columns)


def signed(rows: DataFrame) -> DataFrame:
    """Signed sums of change rows by group."""
    names = {c.lower() for c in rows.columns}
    blank = lambda c: F.col(c) if c in names else F.lit(None)
    part = lambda sign, pre: F.struct(
        *(blank(pre + k).cast("string").alias(k) for k in KEYS),
        F.lit(sign).cast("long").alias("n_docs"),
        (sign * F.coalesce(blank(pre + "n_tokens").cast("long"), F.lit(0))).cast("long").alias("n_tokens"),
    )
    parts = (
        F.when(F.col("op") == "insert", F.array(part(1, "")))
        .when(F.col("op") == "delete", F.array(part(-1, "")))
        .when(F.col("op") == "revise", F.array(part(1, ""), part(-1, "old_")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    )
    flat = rows.select(F.explode(parts).alias("p")).select("p.*")
    return flat.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """A store of signed batches in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _mark(self, name: str, what: str) -> bool:
        """Puts a marker with a text in place; False if there is one already. It is written aside first. On a local file system a link to it is made, which fails where something stands; others rename at once, and only where nothing does."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        done, aside = jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.hadoop.fs.Path(f"{self.folder}/aside/{uuid.uuid4().hex}")
        fs = done.getFileSystem(conf)
        out = fs.create(aside, False)
        out.write(bytearray(what.encode("utf-8")))
        out.close()
        fs.mkdirs(done.getParent())
        try:
            if fs.getScheme() == "file":
                local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(local(done), local(aside))
            else:
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(done.toUri(), conf).rename(aside, done, options)
                return True
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            return False
        finally:
            fs.delete(aside, False)
        return True

    def _names(self, kind: str) -> dict[str, str]:
        """Committed names with the text of their markers."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return {}
        found = {}
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".done"):
                stream = fs.open(status.getPath())
                found[name[:-5]] = bytes(stream.readAllBytes()).decode("utf-8")
                stream.close()
        return found

    def _state(self) -> tuple[dict[str, str], list[tuple[str, set[str]]]]:
        """The batches with markers, and the snapshots with what they hold, oldest first. Batches are listed first: one that is folded and dropped between the two listings is then in a snapshot."""
        batches, snapshots = self._names("batches"), self._names("snapshots")
        return batches, [(lines[0], set(lines[1:])) for n in sorted(snapshots) if (lines := snapshots[n].split("\n"))]

    def committed(self) -> set[str]:
        """Names of all batches that count."""
        batches, snapshots = self._state()
        return (snapshots[-1][1] if snapshots else set()) | set(batches)

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Adds the changes under a name; False if that name counts already."""
        if not batch or "/" in batch or "\n" in batch:
            raise ValueError(f"no name for a batch: {batch!r}")
        if batch in self.committed():
            return False
        where = f"{self.folder}/batches/{batch}-{uuid.uuid4().hex[:12]}"
        with small_batches(self.spark):
            signed(rows).write.parquet(where)
        if self._mark(f"{self.folder}/batches/{batch}.done", where):
            return True
        delete_path(self.spark, where)  # another writer was first
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens over all batches that count."""
        return self._sums(*self._state())

    def _sums(self, batches: dict[str, str], snapshots: list[tuple[str, set[str]]]) -> DataFrame:
        held = snapshots[-1][1] if snapshots else set()
        paths = [where for b, where in sorted(batches.items()) if b not in held] + [where for where, _ in snapshots[-1:]]
        rows = self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Folds the batches that count now into a snapshot. What the snapshot before had folded goes then, and snapshots older than that: totals that were asked for before this compaction can still be read until the next. A compaction that dies, or comes second, leaves totals as they are."""
        batches, snapshots = self._state()
        held = snapshots[-1][1] if snapshots else set()
        n = 1 + max(map(int, self._names("snapshots")), default=-1)
        where = f"{self.folder}/snapshots/{n:08d}-{uuid.uuid4().hex[:12]}"
        self._sums(batches, snapshots).write.parquet(where)
        if not self._mark(f"{self.folder}/snapshots/{n:08d}.done", "\n".join([where, *sorted(held | set(batches))])):
            delete_path(self.spark, where)  # another compaction was first
            return
        for b in held & set(batches):
            delete_path(self.spark, f"{self.folder}/batches/{b}.done")
            delete_path(self.spark, batches[b])
        for folder, _ in snapshots[:-1]:
            delete_path(self.spark, f"{folder.rsplit('-', 1)[0]}.done")
            delete_path(self.spark, folder)

    def exists(self) -> bool:
        return path_exists(self.spark, self.folder)
