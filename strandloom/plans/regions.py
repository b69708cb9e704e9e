"""Regions over intervals made from orders (one-based, inclusive) and points from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import regions as R
from strandloom.operators import bin_cube
from strandloom.operators import intervals as I
from strandloom.operators.ordering import places
from strandloom.plans.registry import Tables, query

WIDTH = 4096
_IV = "SELECT o_orderkey AS id, o_custkey % 25 AS c, o_orderkey * 10 AS s, o_orderkey * 10 + CAST(floor(o_totalprice / 200) AS BIGINT) AS e FROM orders"


def _intervals(t: Tables, p: str = ""):
    s = F.col("o_orderkey") * 10
    return t.orders.select(F.col("o_orderkey").alias(p + "id"), (F.col("o_custkey") % 25).alias(p + "c"), s.alias(p + "s"), (s + F.floor(F.col("o_totalprice") / 200)).alias(p + "e"))


@query(f"SELECT id, s, e, CASE WHEN s >= 20000 AND e <= 60000 THEN 'in range' WHEN s < 20000 AND e > 60000 THEN 'contains range' WHEN s < 20000 THEN 'overlaps start' ELSE 'overlaps end' END AS relation FROM ({_IV}) WHERE c = 7 AND s <= 60000 AND e >= 20000")
def region_overlap(t: Tables):
    hit = _intervals(t).where((F.col("c") == 7) & R.overlaps(F.col("s"), F.col("e"), F.lit(20000), F.lit(60000)))
    return hit.select("id", "s", "e", R.range_relation(F.col("s"), F.col("e"), 20000, 60000).alias("relation"))


@query(f"SELECT 'small' AS kind, id FROM ({_IV}) WHERE c = 3 AND s <= 90000 AND e >= 1000 AND e - s < 700 UNION ALL SELECT 'sv', id FROM ({_IV}) WHERE c = 3 AND s <= 90000 AND e >= 1000 AND e - s >= 700")
def region_union(t: Tables):
    hit = _intervals(t).where((F.col("c") == 3) & R.overlaps(F.col("s"), F.col("e"), F.lit(1000), F.lit(90000)))
    wide = F.col("e") - F.col("s") >= 700
    return hit.where(~wide).select(F.lit("small").alias("kind"), "id").unionByName(hit.where(wide).select(F.lit("sv").alias("kind"), "id"))


@query(f"SELECT CASE WHEN e - s >= 700 THEN 'sv' ELSE 'small' END AS feature, CASE WHEN s >= 20000 AND e <= 60000 THEN 'in range' WHEN s < 20000 AND e > 60000 THEN 'contains range' WHEN s < 20000 THEN 'overlaps start' ELSE 'overlaps end' END AS relation, count(*) AS n FROM ({_IV}) WHERE s <= 60000 AND e >= 20000 GROUP BY 1, 2")
def region_summary(t: Tables):
    hit = _intervals(t).where(R.overlaps(F.col("s"), F.col("e"), F.lit(20000), F.lit(60000)))
    return hit.groupBy(F.when(F.col("e") - F.col("s") >= 700, "sv").otherwise("small").alias("feature"), R.range_relation(F.col("s"), F.col("e"), 20000, 60000).alias("relation")).agg(F.count("*").alias("n"))


@query(f"WITH i AS ({_IV}) SELECT a.id AS left_id, b.id AS right_id FROM i a JOIN i b ON a.c = b.c AND a.s <= b.e AND b.s <= a.e AND a.id <> b.id")
def overlap_join(t: Tables):
    pairs = I.overlap_join(_intervals(t, "l_"), _intervals(t, "r_"), ("l_c", "r_c"), WIDTH)
    return pairs.where("l_id <> r_id").select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))


_PT = "SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey % 25 AS c, l_orderkey * 10 + l_linenumber AS p FROM lineitem"


def _near(t: Tables):
    points = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 25).alias("l_c"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l_p"))
    return I.point_join(points, _intervals(t, "r_"), ("l_c", "r_c"), WIDTH, 500)


@query(f"SELECT p.k AS l_orderkey, p.n AS l_linenumber, g.id AS gene FROM ({_PT}) p JOIN ({_IV}) g ON p.c = g.c AND p.p BETWEEN g.s - 500 AND g.e + 500", also="flank_join_whole")
def flank_join(t: Tables):
    return _near(t).select("l_orderkey", "l_linenumber", F.col("r_id").alias("gene"))


def _positions(near):
    where = R.relative_position(F.col("l_p"), F.col("r_s"), F.col("r_e")).alias("relative_position")
    return near.groupBy(F.col("r_id").alias("gene"), where).agg(F.count("*").alias("n"))


@query(f"SELECT g.id AS gene, CASE WHEN p.p < g.s THEN 'upstream' WHEN p.p > g.e THEN 'downstream' ELSE 'in gene' END AS relative_position, count(*) AS n FROM ({_PT}) p JOIN ({_IV}) g ON p.c = g.c AND p.p BETWEEN g.s - 500 AND g.e + 500 GROUP BY 1, 2", also="relative_position_whole")
def relative_position(t: Tables):
    return _positions(_near(t))


@query(f"WITH i AS ({_IV}) SELECT a.id, string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id) FILTER (WHERE b.id % 3 = a.id % 3) AS alternative, string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id) FILTER (WHERE b.id % 3 <> a.id % 3) AS colocated FROM i a JOIN i b ON a.c = b.c AND a.s <= b.e AND b.s <= a.e AND a.id <> b.id GROUP BY a.id")
def colocated(t: Tables):
    pairs = I.overlap_join(_intervals(t, "l_"), _intervals(t, "r_"), ("l_c", "r_c"), WIDTH).where("l_id <> r_id")
    joined = lambda cond: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("r_id")))), lambda x: x.cast("string")), ","), F.lit(""))
    same = F.col("r_id") % 3 == F.col("l_id") % 3
    return pairs.groupBy(F.col("l_id").alias("id")).agg(joined(same).alias("alternative"), joined(~same).alias("colocated"))


_TREE = """
WITH RECURSIVE b(chromosome, path, level, s, e) AS (
 SELECT 'chr' || k, 'chr' || k, 0, CAST(1 AS BIGINT), CAST(1000000 * k AS BIGINT) FROM (VALUES (1), (2), (3)) v(k)
 UNION ALL
 SELECT chromosome, path || '.L' || (level + 1) || '.B' || side, level + 1, CASE WHEN side = 1 THEN s ELSE s + (e - s + 1) // 2 END, CASE WHEN side = 1 THEN s + (e - s + 1) // 2 - 1 ELSE e END
 FROM b, (VALUES (1), (2)) x(side) WHERE (e - s + 1) // 2 >= 15625)
"""


_LENGTHS = [(f"chr{k}", 1_000_000 * k) for k in (1, 2, 3)]


def _tree(t: Tables):
    return I.bin_tree(t.spark, _LENGTHS)


def _lengths(t: Tables):
    return t.spark.createDataFrame(_LENGTHS, "chromosome string, end long")


@query(_TREE + "SELECT chromosome, path, level, s AS start, e AS \"end\" FROM b")
def interval_bins(t: Tables):
    return _tree(t)


_SPANS = "SELECT o_orderkey AS id, 'chr' || (o_custkey % 3 + 1) AS chromosome, o_orderkey % 900000 + 1 AS s, o_orderkey % 900000 + 1 + CAST(floor(o_totalprice / 10) AS BIGINT) AS e FROM orders"


def _spans(t: Tables):
    s = F.col("o_orderkey") % 900000 + 1
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("chr"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("chromosome"), s.alias("s"), (s + F.floor(F.col("o_totalprice") / 10)).alias("e"))


@query(_TREE + f"SELECT x.id, max_by(b.path, b.level) AS path FROM ({_SPANS}) x LEFT JOIN b ON b.chromosome = x.chromosome AND b.s <= x.s AND x.e <= b.e GROUP BY x.id")
def bin_assign(t: Tables):
    return I.assign_bins(_spans(t), _lengths(t)).select("id", "path")


@query(_TREE + f", a AS (SELECT x.id, x.s, x.e, max_by(b.path, b.level) AS path FROM ({_SPANS}) x LEFT JOIN b ON b.chromosome = x.chromosome AND b.s <= x.s AND x.e <= b.e GROUP BY ALL) SELECT id % 10 AS track_id, path, count(*) AS num_hits, min(s) AS first_start, max(e) AS last_end FROM a GROUP BY 1, 2")
def track_interval_index(t: Tables):
    return I.track_index(I.assign_bins(_spans(t), _lengths(t)).withColumn("track_id", F.col("id") % 10))


@query("SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderkey * 10 AS start, o_orderkey * 10 + 5 AS \"end\" FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'part', p_partkey, p_partkey, p_partkey + p_size FROM part WHERE p_partkey = 7) ORDER BY kind NULLS LAST LIMIT 1")
def feature_location(t: Tables):
    o = t.orders.where("o_orderkey = 7").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 5).alias("end"))
    p = t.part.where("p_partkey = 7").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"))
    return o.unionByName(p).orderBy(F.asc_nulls_last("kind")).limit(1)


@query(f"SELECT id, s - 1 AS zero_start, e AS zero_end, e - s + 1 AS length FROM ({_IV})")
def zero_one_based(t: Tables):
    return _intervals(t).select("id", R.zero_based(F.col("s")).alias("zero_start"), F.col("e").alias("zero_end"), R.length(F.col("s"), F.col("e")).alias("length"))


_NAME = "CASE WHEN c = 22 THEN 'chrX' WHEN c = 23 THEN 'chrY' WHEN c = 24 THEN 'chrM' ELSE 'chr' || (c + 1) END"


@query(f"SELECT id, {_NAME} || ':' || s || '-' || e || CASE WHEN id % 2 = 0 THEN ':-' ELSE '' END AS region, {_NAME} AS chromosome, s AS start FROM ({_IV})", also="region_format_whole")
def region_format(t: Tables):
    return _formatted(_intervals(t))


def _chromosome():
    return F.when(F.col("c") == 22, "chrX").when(F.col("c") == 23, "chrY").when(F.col("c") == 24, "chrM").otherwise(F.concat(F.lit("chr"), (F.col("c") + 1).cast("string")))


def _formatted(rows):
    chrom = _chromosome()
    strand = F.when(F.col("id") % 2 == 0, "-").otherwise("+")
    plain = R.format_region(chrom, F.col("s"), F.col("e"))
    parsed = rows.select("id", R.format_region(chrom, F.col("s"), F.col("e"), strand).alias("region"), R.parse_region(plain).alias("p"))
    return parsed.select("id", "region", "p.chromosome", "p.start")


@query(f"SELECT id, CASE WHEN c = 22 THEN 23 WHEN c = 23 THEN 24 WHEN c = 24 THEN 25 ELSE CAST(c + 1 AS INTEGER) END AS ord, row_number() OVER (ORDER BY CASE WHEN c = 22 THEN 23 WHEN c = 23 THEN 24 WHEN c = 24 THEN 25 ELSE c + 1 END, s, id) AS place FROM ({_IV})", also="chrom_sort_whole")
def chrom_sort(t: Tables):
    """Places in the order of chromosomes and starts; no task sorts a whole chromosome."""
    rows = _intervals(t).withColumn("ord", R.chromosome_order(_chromosome()).cast("int"))
    return places(rows, [], [F.col("ord"), F.col("s"), F.col("id")]).select("id", "ord", "place")


_REGIONS = "SELECT s_suppkey AS region, s_suppkey % 25 AS c, s_suppkey * 997 % 40000 + 1 AS a, s_suppkey * 997 % 40000 + 1 + s_suppkey * 131 % 30000 AS b FROM supplier"


@query(f"SELECT r.region, CASE WHEN i.e - i.s >= 700 THEN 'sv' ELSE 'small' END AS feature, count(*) AS n FROM ({_REGIONS}) r JOIN ({_IV}) i ON i.c = r.c AND i.s <= r.b AND i.e >= r.a AND i.s >= 1 GROUP BY 1, 2")
def region_totals(t: Tables):
    """Features that overlap each of many regions, from a cube of bins."""
    k = F.col("s_suppkey")
    start = k * 997 % 40000 + 1
    regions = t.supplier.select(k.alias("region"), (k % 25).cast("string").alias("chromosome"), start.alias("start"), (start + k * 131 % 30000).alias("end"))
    spans = _intervals(t).select(F.col("c").cast("string").alias("chromosome"), "s", "e", F.when(F.col("e") - F.col("s") >= 700, "sv").otherwise("small").alias("feature"))
    return bin_cube.region_counts(bin_cube.build(spans, ["feature"], 512), regions)


@query("SELECT user_id AS track_id, count(*) AS num_overlaps FROM events WHERE value BETWEEN 20 AND 60 GROUP BY 1")
def informative_tracks(t: Tables):
    return t.events.where(F.col("value").between(20, 60)).groupBy(F.col("user_id").alias("track_id")).agg(F.count("*").alias("num_overlaps"))


@query("SELECT user_id AS track_id, count(*) FILTER (WHERE value > 50) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1", also="counts_with_zeros_whole")
def counts_with_zeros(t: Tables):
    tracks = t.events.where("user_id is not null").select(F.col("user_id").alias("track_id"))
    counts = t.events.where("value > 50").groupBy(F.col("user_id").alias("track_id")).agg(F.count("*").alias("n"))
    return I.counts_with_zeros(tracks.distinct(), counts, "track_id", "n")


@query("SELECT DISTINCT user_id AS track_id FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE value > 50)")
def matching_informative(t: Tables):
    mine = t.events.where("event_type = 'click'").select(F.col("user_id").alias("track_id")).distinct()
    return mine.join(t.events.where("value > 50").select(F.col("user_id").alias("track_id")), "track_id", "left_semi")
