"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame functions only. Rows of a source are permuted by a seeded hash and
cut into BLOCKS blocks by its leading bits. The target of a source over its
size says how often every block is drawn; what remains is a prefix of the
permutation, exact to one row. So each source has an exact quota of block
draws. A binary tree over the output shards splits the quotas: at each node the
left half gets a multivariate hypergeometric draw of the node's quotas, so every
shard holds the same number of draws, and each draw is in one shard. Draws of a
source are consecutive places of its permutation: disjoint blocks. Rows are then
dealt to their shards and put into random order there, in lanes whose number follows from the rows and words of the input.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; a target
stops at MOST times the size of its source, and the excess goes to the others by
weight (water filling, solved by one pass over the sources in order of cap over
weight).

Defined results: null and empty texts have size 0 and follow their block; no row comes
more than MOST times. Long texts are words like others: a row is never cut, so a source meets its target to
half the size of one row. Rows with the same id and text share one hash and are drawn together, so repeated
rows and ties go the same way. A source of size 0 gets
target 0 and none of its rows is taken. An empty table gives an empty table. Input columns named like an
output column are replaced by it; other names don't clash. One result for one table and seed, however
the table is partitioned. Sources are as many as a row of the tree holds numbers: thousands, not millions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._shared import fresh, n_words, staged

BLOCKS = 256
#: Buckets of a source in which its draw is looked for, at least, and rows of one bucket, about, in larger tables.
BUCKETS = 4096
BUCKET_ROWS = 1 << 20
#: What one task puts into random order, about: so many words or rows.
LANE_WORDS = 4_000_000
LANE_ROWS = 500_000
MOST = 3
OUTPUT = ("size", "source_size", "target", "copies", "epoch", "shard", "shuffle_key")


def _bits(h: Column, n: int) -> Column:
    """The leading bits of a hash as a number from 0, in the hash's own order."""
    return F.shiftright(h, 64 - n.bit_length() + 1) + n // 2


def permutation_hash(id_col: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))


def _log_factorial(n: Column) -> Column:
    """ln n!: a table below 16, Stirling's series above."""
    small = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(16)))
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.ln(x) - x + 0.5 * F.ln(x * (2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(series)


def _hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """Good ones among draws without replacement, by inversion of u; 14 standard deviations about the mean hold all but 1e-40 of the law."""
    choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    total = good + bad
    mean = F.try_divide(draws * good.cast("double"), total.cast("double"))
    spread = 14 * F.sqrt(F.try_divide(mean * bad.cast("double"), total.cast("double"))) + 4
    low = F.greatest(F.lit(0).cast("long"), draws - bad, F.floor(mean - spread))
    high = F.least(good, draws, F.ceil(mean + spread))
    law = F.transform(F.sequence(low, high), lambda x: F.struct(x.alias("x"), F.exp(choose(good, x) + choose(bad, draws - x) - choose(total, draws)).alias("p")))
    found = F.aggregate(
        law,
        F.struct(F.lit(0.0).alias("below"), low.alias("x")),
        lambda a, e: F.struct((a["below"] + e["p"]).alias("below"), F.when(a["below"] <= u, e["x"]).otherwise(a["x"]).alias("x")),
        lambda a: a["x"],
    )
    return F.when((draws <= 0) | (good <= 0), F.lit(0).cast("long")).when(bad <= 0, draws).otherwise(found)


def _split(quotas: Column, draws: Column, node: Column, seed: int) -> Column:
    """A multivariate hypergeometric draw from the quotas: source after source, from what is left of both."""
    zero = F.lit(0).cast("long")
    uniform = lambda i: (F.xxhash64(F.lit(seed), node, i).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / float(1 << 53)
    start = F.struct(draws.alias("draws"), F.aggregate(quotas, zero, lambda a, x: a + x).alias("total"), F.array().cast("array<long>").alias("out"))

    def step(a: Column, q: Column) -> Column:
        x = _hypergeometric(uniform(F.size(a["out"])), q, a["total"] - q, a["draws"])
        drawn = F.concat(a["out"], F.array(x))
        last = F.element_at(drawn, -1)
        return F.struct((a["draws"] - last).alias("draws"), (a["total"] - q).alias("total"), drawn.alias("out"))

    return F.aggregate(quotas, start, step, lambda a: a["out"])


def splitting_tree(sources: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """place, shards: for each source (place from 0, quota) the shard of each of its draws, in order. sources must be few enough for one row."""
    zero = F.lit(0).cast("long")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "quota"))), lambda x: x["quota"])
    nodes = sources.agg(ordered.alias("quotas")).select(F.lit(0).alias("low"), F.lit(n_shards).alias("high"), "quotas", F.aggregate("quotas", zero, lambda a, x: a + x).alias("all"))
    for _ in range(max(0, (n_shards - 1).bit_length())):
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        upto = lambda s: F.floor(F.col("all") * s / n_shards)
        parts = nodes.select("*", middle.alias("middle")).select(
            "*",
            F.when(
                F.col("high") - F.col("low") > 1,
                _split(F.col("quotas"), (upto(F.col("middle")) - upto(F.col("low"))).cast("long"), F.col("low") * F.lit(1 << 20).cast("long") + F.col("high"), seed),
            ).alias("left"),
        )
        both = F.when(
            F.col("left").isNull(), F.array(F.struct(F.col("low").alias("l"), F.col("high").alias("h"), F.col("quotas").alias("q")))
        ).otherwise(
            F.array(
                F.struct(F.col("low").alias("l"), F.col("middle").alias("h"), F.col("left").alias("q")),
                F.struct(F.col("middle").alias("l"), F.col("high").alias("h"), F.zip_with("quotas", "left", lambda a, b: a - b).alias("q")),
            )
        )
        nodes = parts.select("all", F.explode(both).alias("node")).select(F.col("node.l").alias("low"), F.col("node.h").alias("high"), F.col("node.q").alias("quotas"), "all")
    leaves = nodes.select(F.col("low").alias("shard"), F.posexplode("quotas").alias("place", "n"))
    runs = F.array_sort(F.collect_list(F.struct("shard", "n")))
    return leaves.groupBy("place").agg(F.flatten(F.transform(runs, lambda r: F.array_repeat(r["shard"], r["n"].cast("int")))).alias("shards"))


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """source, source_size, place and target from source and source_size; one row for each source."""
    first = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.select("*", (F.row_number().over(first) - 1).alias("place"))
    rows = rows.select("*", (F.col("place") % 3 + 1).cast("double").alias("weight"), (most * F.col("source_size")).cast("double").alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = rows.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("rest"),
        F.sum("source_size").over(every).cast("double").alias("total"),
    )
    level = F.try_divide(F.col("total") - F.col("capped"), F.col("rest"))
    levels = sums.select("*", F.when(F.col("cap") / F.col("weight") >= level, level).alias("level"))
    filled = levels.select("*", F.max("level").over(every).alias("water"))
    return filled.select("source", "source_size", "place", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def plan(sized: DataFrame, n_shards: int, seed: int, buckets: int = BUCKETS) -> DataFrame:
    """One row for each source: target, base (draws of every row), last (greatest hash of the rows drawn once more) and the shard of each block draw. sized: source, h, size."""
    cell = sized.select("source", _bits(F.col("h"), buckets).alias("bucket"), "size", "h")
    cells = staged(cell.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-cells")
    aims = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")))
    part = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    aims = aims.select("*", F.least(part, F.lit(MOST)).cast("int").alias("base"))
    aims = staged(aims.select("*", F.when(F.col("base") >= MOST, F.lit(0.0)).otherwise(F.col("target") - F.col("base") * F.col("source_size")).alias("residual")), "mix-aims")
    # The bucket in which the residual ends, then the row. Sources without a residual have no such bucket.
    running = cells.select("*", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")).alias("upto"))
    same = running["source"].eqNullSafe(aims["source"])
    edge = running.join(aims.where("residual > 0").select("source", "residual"), same).select(running["*"], "residual").where(F.col("upto") > F.col("residual"))
    edge = edge.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "residual"), "bucket").alias("e"))
    edge = staged(edge.select("source", "e.*"), "mix-edge")
    at_edge = cell.join(edge, cell["source"].eqNullSafe(edge["source"]) & (cell["bucket"] == edge["bucket"])).select(cell["*"], "before", "residual")
    sums = at_edge.select("source", "h", "residual", (F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("h").rangeBetween(Window.unboundedPreceding, 0))).alias("upto"))
    off = F.abs(F.col("upto") - F.col("residual"))
    nearest = sums.groupBy("source").agg(F.min_by(F.struct("h", off.alias("off")), F.struct(off, "h")).alias("n"))
    edge = edge.join(nearest, edge["source"].eqNullSafe(nearest["source"]), "left").select(edge["*"], "n")
    none = F.col("n").isNull() | (F.col("n.off") >= F.abs(F.col("before") - F.col("residual")))
    # None of the edge bucket: the last hash is the one before its first.
    start = F.shiftleft((F.col("bucket") - buckets // 2).cast("long"), 64 - buckets.bit_length() + 1)
    nothing = none & (F.col("bucket") == 0)
    edge = edge.select("source", F.when(nothing, F.lit(None)).when(none, start - 1).otherwise(F.col("n.h")).alias("last"))
    aims = aims.join(edge, aims["source"].eqNullSafe(edge["source"]), "left").select(aims["*"], "last")
    extra = F.when(F.col("last").isNull(), 0).otherwise(_bits(F.col("last"), BLOCKS) + 1)
    aims = staged(aims.select("*", (F.col("base") * BLOCKS + extra).cast("long").alias("quota")), "mix-plan")
    shards = staged(splitting_tree(aims.select("place", "quota"), n_shards, seed), "mix-tree")
    return staged(aims.join(shards, "place", "left"), "mix-sources")


def lanes_for(rows: int, words: int, n_shards: int) -> int:
    """Parts of a shard that are put into order alone: the mix holds as many words as the input."""
    return max(1, -(-max(rows * LANE_WORDS // LANE_ROWS, words) // (LANE_WORDS * n_shards)))


def mix(docs: DataFrame, n_shards: int = 64, seed: int = 20240307, id_col: str = "doc_id", text: str = "text", source: str = "source", lanes: int | None = None) -> DataFrame:
    """docs once for each time that the mix takes it (copies in all; epoch from 0), with its shard, in random order there by shuffle_key. A row that the mix takes no time comes once, with copies 0 and null epoch and shard. lanes: parts of a shard that are put into order alone, by default from the size of the input."""
    keep = [c for c in docs.columns if c.lower() not in OUTPUT]
    sized = staged(docs.select(F.col(source).alias("source"), permutation_hash(id_col, text, seed).alias("h"), n_words(F.col(text)).alias("size")), "mix-sizes")
    rows_in, words_in = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(BUCKETS, 1 << (rows_in // BUCKET_ROWS).bit_length())
    lanes = lanes or lanes_for(rows_in, words_in, n_shards)
    of, base, last, shards, h = fresh(docs.select(*keep), "of_", "base_", "last_", "shards_", "h_")
    per_source = plan(sized, n_shards, seed, buckets).select(F.col("source").alias(of), "source_size", "target", F.col("base").alias(base), F.col("last").alias(last), F.col("shards").alias(shards))
    rows = docs.select(*keep, n_words(F.col(text)).alias("size"), permutation_hash(id_col, text, seed).alias(h))
    rows = rows.join(per_source, rows[source].eqNullSafe(per_source[of]), "left")
    copies = F.col(base) + F.when(F.col(h) <= F.col(last), 1).otherwise(0)
    rows = rows.select(*keep, "size", "source_size", "target", shards, h, copies.cast("int").alias("copies"))
    epochs = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1))
    rows = rows.select("*", F.explode_outer(epochs).alias("epoch"))
    draw = F.col("epoch") * BLOCKS + _bits(F.col(h), BLOCKS)
    rows = rows.select(*keep, "size", "source_size", "target", "copies", "epoch", F.get(shards, draw.cast("int")).alias("shard"), F.xxhash64(F.lit(seed), h, "epoch").alias("shuffle_key"))
    lane = F.pmod("shuffle_key", F.lit(lanes))
    # Rows that no shard takes are dealt out like the others.
    to = F.coalesce("shard", F.pmod("shuffle_key", F.lit(n_shards)).cast("int"))
    return rows.repartition(to, lane).sortWithinPartitions("shard", lane, "shuffle_key")
