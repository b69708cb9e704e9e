"""Reference sequences: FASTA files as tables of fixed chunks.

A file is read as lines, in as many splits as Spark likes. Each line knows the split that it came from
and its place there, so the place of its first base follows from sums within the split and from
the few totals of the splits before; no task reads a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bases in a chunk. A join by chunk moves chunks and variants, never a sequence.
CHUNK = 4096
SEQUENCE = "name string, chunk long, bases string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split, place (in order within a split), name (of header lines) and bases (of others)."""
    text = F.trim("value")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), text.alias("line"))
    header = F.startswith("line", F.lit(">"))
    name = F.when(header, F.regexp_extract("line", r"^>\s*(\S*)", 1))
    return rows.select("file", "split", "place", name.alias("name"), F.when(~header & ~F.startswith("line", F.lit(";")), F.upper("line")).otherwise("").alias("bases"))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """name, start (of the first base, from 0) and bases of each line of FASTA files. Lines before the first header of a file have a null name."""
    lines = _lines(spark, path)
    so_far = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last("name", ignorenulls=True).over(so_far)
    total = F.sum(F.length("bases").cast("long")).over(so_far)
    lines = lines.select("*", own.alias("own"), total.alias("total"))
    lines = lines.select("*", F.coalesce(F.last(F.when(F.col("name").isNotNull(), F.col("total")), ignorenulls=True).over(so_far), F.lit(0)).alias("reset"))
    # A row for each split: the last name in it, and the bases behind that.
    splits = lines.groupBy("file", "split").agg(F.max_by("own", "place").alias("last"), F.max_by(F.col("total") - F.col("reset"), "place").alias("tail"))
    in_file = Window.partitionBy("file").orderBy("split")
    splits = splits.select("*", F.sum(F.col("last").isNotNull().cast("int")).over(in_file).alias("run"))
    splits = splits.select("*", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("split")).alias("end"), F.last("last", ignorenulls=True).over(in_file).alias("known"))
    before = splits.select("file", "split", F.lag("known").over(in_file).alias("name_before"), F.coalesce(F.lag("end").over(in_file), F.lit(0)).alias("end_before"))
    rows = lines.join(before, ["file", "split"])
    start = F.col("total") - F.length("bases") - F.col("reset") + F.when(F.col("own").isNull(), F.col("end_before")).otherwise(0)
    return rows.where("bases <> ''").select(F.coalesce("own", "name_before").alias("name"), start.alias("start"), "bases")


def in_chunks(pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """name, chunk (from 0) and bases of sequences that come in pieces (name, start from 0, bases), which may have any length but must leave no gap."""
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.length("bases") - 1) / size)
    cut = pieces.where("bases <> ''").select("name", "start", "bases", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("chunk"))
    low = F.greatest(F.col("chunk") * size, F.col("start"))
    part = F.substr("bases", (low - F.col("start") + 1).cast("int"), (F.least((F.col("chunk") + 1) * size, F.col("start") + F.length("bases")) - low).cast("int"))
    parts = cut.select("name", "chunk", F.struct(low.alias("at"), part.alias("part")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "")
    return parts.groupBy("name", "chunk").agg(joined.alias("bases"))  # a chunk is bounded, and so is what it is joined of


def read_fasta(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """The sequences of FASTA files in chunks, upper-case. Two sequences of one name raise an error when the chunk of both is longer than a chunk can be."""
    rows = in_chunks(placed_lines(spark, path), size)
    fine = F.length("bases") <= size
    return rows.select("name", "chunk", F.when(fine, F.col("bases")).otherwise(F.raise_error(F.concat(F.lit("two sequences are named "), F.coalesce("name", F.lit("null"))))).alias("bases"))
