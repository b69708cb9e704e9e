"""Interval joins and the hierarchical bin index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BIN = 15_625
MOST_BUCKETS = 64


def bin_tree(spark: SparkSession, lengths: list[tuple[str, int]], least: int = LEAST_BIN) -> DataFrame:
    """chromosome, path, level, start and end of all bins. A bin is halved (the left half gets the smaller part) while the halves are not below the least width. Levels are few, so each is one explode of the one before."""
    level = spark.createDataFrame(lengths, "chromosome string, end long").select("chromosome", F.col("chromosome").alias("path"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("start"), "end")
    out, width, depth = level, max((n for _, n in lengths), default=0), 0
    while width // 2 >= least:
        depth += 1
        half = F.floor((F.col("end") - F.col("start") + 1) / 2)
        side = lambda k, s, e: F.struct(F.concat("path", F.lit(f".L{depth}.B{k}")).alias("path"), s.cast("long").alias("start"), e.cast("long").alias("end"))  # noqa: B023, E731
        pair = F.array(side(1, F.col("start"), F.col("start") + half - 1), side(2, F.col("start") + half, F.col("end")))
        level = level.where(half >= least).select("chromosome", F.lit(depth).alias("level"), F.explode(pair).alias("b")).select("chromosome", "b.path", "level", "b.start", "b.end")
        out, width = out.unionByName(level), -(-width // 2)
    return out


def bucketed(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    """df once for each bucket of the width that an interval touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def bucket_width(intervals: DataFrame, start: str, end: str, least: int = 64) -> int:
    """A width that nine in ten intervals don't pass: each is in two buckets at most."""
    found = intervals.agg(F.percentile_approx(F.col(end) - F.col(start) + 1, 0.9)).first()[0]
    return max(least, int(found or 0))


def overlap_join(left: DataFrame, right: DataFrame, keys: tuple[str, str], width: int | None = None, flank: int = 0) -> DataFrame:
    """Pairs of overlapping intervals on one chromosome. Each side has columns key, s and e (named by its prefix, `l_` or `r_`: see below); the hash join is on key and bucket, and a pair counts only in the first bucket that both touch, so it comes once. Intervals over more than MOST_BUCKETS buckets go by coarse buckets of their own.

    left: keys[0], l_s, l_e; right: keys[1], r_s, r_e. flank widens the right side. width: of the buckets; without one it follows from the lengths of both sides."""
    if width is None:
        width = max(bucket_width(left, "l_s", "l_e"), bucket_width(right, "r_s", "r_e") + 2 * flank)
    right = right.withColumn("_s", F.col("r_s") - flank).withColumn("_e", F.col("r_e") + flank)
    coarse = width * MOST_BUCKETS

    def part(a: DataFrame, b: DataFrame, w: int) -> DataFrame:
        x, y = bucketed(a, "l_s", "l_e", w, "_x"), bucketed(b, "_s", "_e", w, "_y")
        on = (x[keys[0]] == y[keys[1]]) & (x["_x"] == y["_y"])
        both = x.join(y, on).where((F.col("l_s") <= F.col("_e")) & (F.col("_s") <= F.col("l_e")))
        return both.where(F.col("_x") == F.greatest(F.floor(F.col("l_s") / w), F.floor(F.col("_s") / w))).drop("_x", "_y")

    wide_l, wide_r = (F.col("l_e") - F.col("l_s")) > coarse, (F.col("_e") - F.col("_s")) > coarse
    fine = part(left.where(~wide_l), right.where(~wide_r), width)
    rest = part(left.where(wide_l), right, coarse).unionByName(part(left.where(~wide_l), right.where(wide_r), coarse))
    return fine.unionByName(rest).drop("_s", "_e")


def point_join(points: DataFrame, intervals: DataFrame, keys: tuple[str, str], width: int, flank: int = 0) -> DataFrame:
    """Points (l_p) in intervals (r_s, r_e, widened by flank): a point has one bucket, so only intervals are copied."""
    x = points.withColumn("_x", F.floor(F.col("l_p") / width))
    y = bucketed(intervals.withColumn("_s", F.col("r_s") - flank).withColumn("_e", F.col("r_e") + flank), "_s", "_e", width, "_y")
    both = x.join(y, (x[keys[0]] == y[keys[1]]) & (x["_x"] == y["_y"]))
    return both.where((F.col("l_p") >= F.col("_s")) & (F.col("l_p") <= F.col("_e"))).drop("_x", "_y", "_s", "_e")


def assign_bins(spans: DataFrame, lengths: DataFrame, least: int = LEAST_BIN, clamp: bool = False) -> DataFrame:
    """spans (chromosome, s, e and others) with the path of the deepest bin of bin_tree that contains each; null for a span that no chromosome holds. lengths: chromosome and end, a row for each chromosome. The tree is arithmetic, so it is walked from the chromosome's length in one expression and never joined. clamp: a span that passes the end of its chromosome counts as far as that."""
    of = lengths.select("chromosome", F.col("end").cast("long").alias("_length"))
    end = F.least("e", "_length") if clamp else F.col("e")
    root = F.struct(F.lit(1).cast("long").alias("start"), F.col("_length").alias("end"), F.col("chromosome").alias("path"), F.lit(False).alias("done"))
    depth = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.col("_length") / least, F.lit(1.0)))).cast("int"))

    def halve(bin_: Column, level: Column) -> Column:
        half = F.floor((bin_["end"] - bin_["start"] + 1) / 2)
        left, right = end < bin_["start"] + half, F.col("s") >= bin_["start"] + half
        done = bin_["done"] | (half < least) | ~(left | right)
        return F.struct(
            F.when(done | left, bin_["start"]).otherwise(bin_["start"] + half).alias("start"),
            F.when(~done & left, bin_["start"] + half - 1).otherwise(bin_["end"]).alias("end"),
            F.when(done, bin_["path"]).otherwise(F.concat(bin_["path"], F.lit(".L"), level.cast("string"), F.when(left, ".B1").otherwise(".B2"))).alias("path"),
            done.alias("done"),
        )

    inside = (F.col("s") >= 1) & (F.col("s") <= end) & (end <= F.col("_length"))
    path = F.when(inside, F.aggregate(F.sequence(F.lit(1), depth), root, halve, lambda bin_: bin_["path"]))
    return spans.join(of, "chromosome", "left").select(*spans.columns, path.alias("path"))


def track_index(hits: DataFrame) -> DataFrame:
    """Hits (track_id, path, s, e) counted by track and bin, with their extent."""
    return hits.groupBy("track_id", "path").agg(F.count("*").alias("num_hits"), F.min("s").alias("first_start"), F.max("e").alias("last_end"))


def counts_with_zeros(requested: DataFrame, counts: DataFrame, key: str, n: str) -> DataFrame:
    """Counts of the requested keys, 0 where there is none."""
    return requested.join(counts, key, "left").withColumn(n, F.coalesce(F.col(n), F.lit(0)))
