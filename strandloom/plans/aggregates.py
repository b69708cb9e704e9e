"""Counts, sets, groups and running sums."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.operators import gwas
from strandloom.operators.metadata import shard_key
from strandloom.operators.validation import duplicates
from strandloom.plans.registry import Tables, query


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def filter_summary(t: Tables):
    return t.documents.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source")
def filter_distinct(t: Tables):
    return t.documents.where("source is not null").select("source").distinct().orderBy("source")


@query("SELECT CAST(count(DISTINCT lang) AS BIGINT) AS n_builds, CASE WHEN count(DISTINCT lang) > 1 THEN 'mixed' ELSE min(lang) END AS build FROM documents")
def genome_build_check(t: Tables):
    return t.documents.agg(F.countDistinct("lang").alias("n_builds"), F.when(F.countDistinct("lang") > 1, "mixed").otherwise(F.min("lang")).alias("build"))


@query("SELECT 'chr' || (user_id % 25 + 1) AS chromosome, count(*) AS n FROM events GROUP BY 1 ORDER BY CAST(replace(chromosome, 'chr', '') AS INTEGER)")
def counts_by_chrom(t: Tables):
    rows = t.events.groupBy(F.concat(F.lit("chr"), (F.col("user_id") % 25 + 1).cast("string")).alias("chromosome")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.replace("chromosome", F.lit("chr"), F.lit("")).try_cast("int"))


@query("SELECT count(*) AS n, count(lang) AS n_lang FROM documents")
def track_count(t: Tables):
    return t.documents.agg(F.count("*").alias("n"), F.count("lang").alias("n_lang"))


@query("SELECT r_regionkey, r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL ORDER BY r_regionkey")
def collection_counts(t: Tables):
    return t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.count("*").alias("n")).orderBy("r_regionkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS num_associations FROM lineitem GROUP BY ALL")
def association_counts(t: Tables):
    return gwas.association_counts(t.lineitem, "l_returnflag", "l_linestatus")


@query("SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE l_quantity < 15) AS upstream, count(*) FILTER (WHERE l_quantity BETWEEN 15 AND 35) AS in_gene, count(*) FILTER (WHERE l_quantity > 35) AS downstream, count(*) AS total FROM lineitem GROUP BY ALL")
def association_counts_by_position(t: Tables):
    rows = t.lineitem.withColumn("position", F.when(F.col("l_quantity") < 15, "upstream").when(F.col("l_quantity") > 35, "downstream").otherwise("in gene"))
    return gwas.association_counts_by_position(rows, "l_returnflag", "l_linestatus", "position", ["upstream", "in gene", "downstream"])


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS evidence FROM events GROUP BY 1")
def evidence_set(t: Tables):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("evidence"))


@query("SELECT n_regionkey, string_agg(n_name || ':' || n_nationkey, ';' ORDER BY n_name) AS annotation FROM nation GROUP BY 1")
def go_annotation_agg(t: Tables):
    rows = F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.transform(rows, lambda r: F.concat(r["n_name"], F.lit(":"), r["n_nationkey"].cast("string"))), ";").alias("annotation"))


@query(None)
def shard_groups(t: Tables):
    """Shards of a track under one digest key (SHA-512 has no SQL function in the oracle)."""
    rows = t.part.select("p_partkey", F.concat(F.lit("track"), (F.col("p_partkey") % 100).cast("string"), F.lit("_chr"), (F.col("p_partkey") % 22 + 1).cast("string"), F.lit(".bed")).alias("name"))
    return rows.groupBy(shard_key(F.col("name")).alias("shard_key")).agg(F.array_sort(F.collect_list("p_partkey")).alias("members"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(t: Tables):
    return duplicates(t.part.select("p_name"), "p_name")


@query("SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def dedupe_ci(t: Tables):
    first = t.part.groupBy(F.lower("p_brand").alias("k")).agg(F.min(F.struct("p_partkey", "p_brand")).alias("f"))
    return first.select("f.p_partkey", "f.p_brand")


@query("SELECT event_id, CAST(sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events")
def cumulative_sum(t: Tables):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.sum(F.col("event_id") % 7).over(w).alias("running"))


@query("SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 5) AS mean FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2")
def avg_arrays(t: Tables):
    rows = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    return rows.groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@query("SELECT event_type, sum(CASE WHEN event_type IN ('click') THEN 0 ELSE 1 END)::BIGINT AS counted, count(*) AS n FROM events GROUP BY 1")
def transaction_tally(t: Tables):
    return t.events.groupBy("event_type").agg(F.sum(F.when(F.col("event_type") == "click", 0).otherwise(1)).alias("counted"), F.count("*").alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT c_custkey AS k, c_name AS v FROM customer) a FULL JOIN (SELECT s_suppkey + 50 AS k, s_name AS v FROM supplier) b ON a.k = b.k", also="merge_track_lists_whole")
def merge_track_lists(t: Tables):
    return _merged(t, t.customer)


def _merged(t: Tables, customers):
    a = customers.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    b = t.supplier.select((F.col("s_suppkey") + 50).alias("k"), F.col("s_name").alias("w"))
    return a.join(b, "k", "full").select("k", F.coalesce("v", "w").alias("v"))
