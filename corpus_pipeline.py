"""From raw documents to packed sequences: quality rules, near duplicates, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, whatever else these are called. The deduplicating stages tell rows apart by
their number, so rows with a null doc_id and rows that share one are treated like others.
Null and empty texts: the quality rules reject them; a later stage that gets one keeps it. Very long texts are
treated whole. Ties go to the smaller doc_id, then to the earlier row; of repeated rows one stays. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import jaccard, mixing, packing, quality, substring
from strandloom.llm._shared import WORD, fresh, ship, staged, steady, table

CAPACITY = 4096
N_SHARDS = 64

#: Tokenisation has no SQL.
ORACLE_SQL = None


def _aside(docs: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, list]:
    """docs with columns whose names a stage needs renamed, and the selection that brings them back."""
    clash = [c for c in docs.columns if c.lower() in taken]
    names = dict(zip(clash, fresh(docs, *(f"{c}_" for c in clash)), strict=True))
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, each as often as it stands."""
    ship(spark)
    docs, back = _aside(docs, quality.OUTPUT)
    return quality.judge(docs).where("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that similarity links, the one with the least doc_id (null: last), then the earliest row."""
    ship(spark)
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier row has; n_chars follows the text. A document of which nothing is left goes."""
    ship(spark)
    docs, back = _aside(docs, ("n_copied", "removed_bytes", "removed_spans"))
    docs = steady(docs, "passages-input")
    (row,) = fresh(docs, "row_")
    out = substring.dedup_substrings(docs.withColumn(row, F.monotonically_increasing_id()), row)
    left = out.where((F.col("removed_bytes") == 0) | F.col("text").rlike(WORD))
    names = [c.lower() for c in docs.columns]
    if "n_chars" in names:
        left = left.withColumn("n_chars", F.when(F.col("removed_bytes") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return left.select(*back)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    docs, back = _aside(docs, mixing.OUTPUT)
    return mixing.mix(docs, N_SHARDS).where(F.col("epoch").isNotNull()).select(*back)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and their places in sequences of at most CAPACITY ids; a null text is an empty one."""
    ship(spark)
    return packing.pack_documents(docs, CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
