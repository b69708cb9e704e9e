"""Counts of spans by a hierarchy of bins: how many overlap a region, from a few rows.

A span overlaps a region from a to b if it starts at b or before and doesn't end before a; so the count is that of starts up to b less that of ends before a. Both
are counts of places in a prefix of the chromosome, and a prefix is a few bins of the hierarchy, one for each level at most, and a part of one bin of the lowest level,
which is scanned. Counts are additive: those of a bin are the sums of its two halves, so new spans are added to a cube by adding cubes.

Spans are chromosome, s and e (from 1, inclusive) and columns to count by. Those with a null, or that end before they start, aren't counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases in a bin of the lowest level, and levels above it. Places in bins from 2^LEVELS on count as the last of these.
LOWEST, LEVELS = 16_384, 24


@dataclass
class BinCube:
    counts: DataFrame  # chromosome, by, side (s or e), level, bin, n
    spans: DataFrame  # chromosome, by, s, e
    by: list[str]
    width: int


def build(spans: DataFrame, by: list[str], width: int = LOWEST) -> BinCube:
    """The cube of spans. Lowest bins are counted first; each of these few rows then adds to the bins above it."""
    rows = spans.where("chromosome IS NOT NULL AND s >= 1 AND e >= s").select("chromosome", *by, F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.floor(F.col(c) / width).cast("long").alias("bin")) for c in "se"]))
    lowest = rows.select("chromosome", *by, sides.alias("x")).select("chromosome", *by, "x.*").groupBy("chromosome", *by, "side", "bin").agg(F.count("*").alias("n"))
    above = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    every = lowest.select("chromosome", *by, "side", F.least("bin", F.lit((1 << LEVELS) - 1)).alias("bin"), "n", above)
    counts = every.groupBy("chromosome", *by, "side", "level", F.expr("shiftright(bin, level)").alias("bin")).agg(F.sum("n").alias("n"))
    return BinCube(counts, rows, by, width)


def added(one: BinCube, other: BinCube) -> BinCube:
    """The cube of the spans of both."""
    both = one.counts.unionByName(other.counts).groupBy(*[c for c in one.counts.columns if c != "n"]).agg(F.sum("n").alias("n"))
    return BinCube(both, one.spans.unionByName(other.spans), one.by, one.width)


def tiles(regions: DataFrame, width: int) -> DataFrame:
    """regions (region, chromosome, start, end) with the bins that make up the two prefixes: side, level, bin and sign. A prefix of n lowest bins has one tile for each bit of n."""
    prefix = lambda side, place, sign: F.struct(F.lit(side).alias("side"), F.least(F.floor(place / width).cast("long"), F.lit(1 << LEVELS)).alias("n"), F.lit(sign).cast("long").alias("sign"))
    sides = regions.select("region", "chromosome", F.explode(F.array(prefix("s", F.col("end"), 1), prefix("e", F.col("start"), -1))).alias("p")).select("region", "chromosome", "p.*")
    bits = sides.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.call_function("shiftright", F.col("n"), k) % 2 == 1)).alias("level"))
    return bits.select("region", "chromosome", "side", "level", (F.expr("shiftright(n, level)") - 1).alias("bin"), "sign")


def region_counts(cube: BinCube, regions: DataFrame) -> DataFrame:
    """region, the columns that the cube counts by, and n: spans that overlap each region (region, a key; chromosome; start and end from 1, inclusive). Groups without any are left out."""
    regions = regions.where("start >= 1 AND end >= start")
    whole = tiles(regions, cube.width).join(cube.counts, ["chromosome", "side", "level", "bin"]).select("region", *cube.by, (F.col("sign") * F.col("n")).alias("n"))

    def edge(place: str, side: str, sign: int) -> DataFrame:
        """The places in the last bin of a prefix, up to (starts) or before (ends) the region's own."""
        of = regions.select("region", F.col("chromosome").alias("c_"), F.col(place).alias("place_"), F.floor(F.col(place) / cube.width).alias("bin_"))
        met = cube.spans.join(of, (F.col("chromosome") == F.col("c_")) & (F.floor(F.col(side) / cube.width) == F.col("bin_")))
        return met.where(F.col(side) <= F.col("place_") if side == "s" else F.col(side) < F.col("place_")).select("region", *cube.by, F.lit(sign).cast("long").alias("n"))

    parts = whole.unionByName(edge("end", "s", 1)).unionByName(edge("start", "e", -1))
    return parts.groupBy("region", *cube.by).agg(F.sum("n").alias("n")).where("n > 0")
