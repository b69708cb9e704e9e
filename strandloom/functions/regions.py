"""Regions: one-based inclusive start and end inside the engine; other conventions at its edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.patterns import CHROMOSOME

#: Contigs of the human genome in their sort order.
CHROMOSOMES = ["chr1", "chr2", "chr3", "chr4", "chr5", "chr6", "chr7", "chr8", "chr9", "chr10", "chr11", "chr12", "chr13", "chr14", "chr15", "chr16", "chr17", "chr18", "chr19", "chr20", "chr21", "chr22", "chrX", "chrY", "chrM"]

RELATIONS = ("in range", "contains range", "overlaps start", "overlaps end")


def chromosome(value: Column) -> Column:
    """chr-prefixed name for 1, chr1, x, MT and the like; null for others."""
    bare = F.replace(F.replace(F.upper(value), F.lit("CHR"), F.lit("")), F.lit("MT"), F.lit("M"))
    name = F.concat(F.lit("chr"), bare)
    return F.when(name.isin(CHROMOSOMES), name)


def chromosome_order(value: Column) -> Column:
    """Rank in the contigs' order: 1 to 22, X, Y, M; null for others."""
    bare = F.replace(F.upper(value), F.lit("CHR"), F.lit(""))
    return F.coalesce(F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25), bare.try_cast("int"))


def zero_based(start: Column) -> Column:
    return start - 1


def one_based(start: Column) -> Column:
    return start + 1


def length(start: Column, end: Column, inclusive: bool = True) -> Column:
    return end - start + (1 if inclusive else 0)


def format_region(chrom: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    """chr:start-end, with the strand only where it is minus."""
    text = F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return text if strand is None else F.concat_ws(":", text, F.when(strand == "-", strand))


def parse_region(text: Column) -> Column:
    """chromosome, start and end of chr:start-end; null if it isn't one."""
    pattern = rf"^((?:chr)?{CHROMOSOME})[:\-](\d+)[\-:](\d+)$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(F.rlike(text, F.lit(pattern)), F.struct(chromosome(part(1)).alias("chromosome"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end")))


def within_limit(start: Column, end: Column, most: int = 50_000) -> Column:
    return end - start <= most


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def range_relation(start: Column, end: Column, low, high) -> Column:
    """How a feature lies to a range that it overlaps."""
    return F.when((start >= low) & (end <= high), RELATIONS[0]).when((start < low) & (end > high), RELATIONS[1]).when(start < low, RELATIONS[2]).otherwise(RELATIONS[3])


def relative_position(position: Column, start: Column, end: Column) -> Column:
    """upstream, downstream or in gene, whatever the strand."""
    return F.when(position < start, "upstream").when(position > end, "downstream").otherwise("in gene")


def is_ancestor(a: Column, b: Column) -> Column:
    """Whether bin path a holds bin path b."""
    return (a == b) | F.startswith(b, F.concat(a, F.lit(".")))
