"""Joins and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators.rag import reach
from strandloom.operators.validation import cross_check
from strandloom.plans.registry import Tables, query


@query("SELECT r_name, n_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'EUROPE'")
def collection_tracks(t: Tables):
    dims = t.nation.join(t.region.where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "c_custkey")


@query("SELECT c_custkey, c_name, coalesce(o.n, 0) AS n_orders, o.first FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def gene_record(t: Tables):
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), "first")


@query("SELECT r_name, string_agg(line, ';' ORDER BY line) AS document FROM (SELECT r_name, n_name || '=' || string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS line FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY r_name, n_name) GROUP BY 1")
def nested_document(t: Tables):
    rich = t.customer.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("customers"))
    nations = t.nation.join(rich, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    line = F.concat("n_name", F.lit("="), F.array_join(F.transform("customers", lambda x: x.cast("string")), ","))
    return t.region.join(nations, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.nullif(F.array_join(F.array_sort(F.collect_list(line)), ";"), F.lit("")).alias("document"))


@query("SELECT id FROM (VALUES (1), (5), (99999), (100000)) v(id) WHERE id NOT IN (SELECT s_suppkey FROM supplier)")
def invalid_tracks(t: Tables):
    asked = t.spark.createDataFrame([(1,), (5,), (99999,), (100000,)], "id int")
    return asked.join(t.supplier, F.col("id") == F.col("s_suppkey"), "left_anti")


@query("SELECT k AS sample_id, 'error' AS level, 'unknown sample' AS message FROM (SELECT DISTINCT l_suppkey + 5 AS k FROM lineitem) WHERE k NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, 'warning', 'no file for sample' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey + 5 FROM lineitem)")
def sample_crosscheck(t: Tables):
    return cross_check(t.lineitem.select((F.col("l_suppkey") + 5).alias("sample_id")), t.supplier.select(F.col("s_suppkey").alias("sample_id")))


@query("SELECT c_custkey, coalesce((SELECT min(o_orderpriority) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000), 'Other') AS category FROM customer")
def scalar_subquery_category(t: Tables):
    best = t.orders.where("o_totalprice > 400000").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"))
    return t.customer.join(best, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("p", F.lit("Other")).alias("category"))


@query("SELECT name, min_by(id, priority) AS id FROM (SELECT lower(c_name) AS name, c_custkey AS id, 1 AS priority FROM customer UNION ALL SELECT lower(replace(s_name, 'Supplier', 'Customer')), s_suppkey + 1000000, 2 FROM supplier) GROUP BY name")
def resolve_symbol(t: Tables):
    a = t.customer.select(F.lower("c_name").alias("name"), F.col("c_custkey").alias("id"), F.lit(1).alias("priority"))
    b = t.supplier.select(F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("name"), (F.col("s_suppkey") + 1000000).alias("id"), F.lit(2).alias("priority"))
    return a.unionByName(b).groupBy("name").agg(F.min_by("id", "priority").alias("id"))


@query("SELECT o_orderkey, l_linenumber, p_name, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderpriority = '1-URGENT' AND l_discount >= 0.09")
def gene_associations(t: Tables):
    hits = t.lineitem.where("l_discount >= 0.09").join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return hits.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("o_orderkey", "l_linenumber", "p_name", "o_orderpriority")


@query("SELECT p_partkey, l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), o_orderstatus) AS test_allele FROM part JOIN lineitem ON l_partkey = p_partkey LEFT JOIN orders ON o_orderkey = l_orderkey", also="variant_associations_whole")
def variant_associations(t: Tables):
    return _associations(t, t.part)


def _associations(t: Tables, parts):
    parts = parts.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"))
    joined = parts.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("p_partkey", "l_orderkey", "l_linenumber", F.coalesce(F.nullif("l_returnflag", F.lit("N")), "o_orderstatus").alias("test_allele"))


@query("""
WITH RECURSIVE w(node, steps) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT b, steps + 1 FROM w JOIN (SELECT o_custkey AS a, o_orderkey % 1500 + 1 AS b FROM orders) ON a = node WHERE steps < 3)
SELECT node, min(steps) AS steps FROM w GROUP BY 1""")
def bounded_traversal(t: Tables):
    edges = t.orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1500 + 1).alias("b"))
    return reach(edges, t.spark.range(1, 2).select(F.col("id").alias("node")), 3)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 15) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def impacted_features(t: Tables):
    hit = t.lineitem.join(t.part.where("p_size = 15"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return hit.join(t.supplier.where("s_acctbal < 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").select("l_orderkey", "l_linenumber")
