"""Graphs: ontologies with restrictions, and patterns of typed edges over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import rag
from strandloom.operators.graph import Step, expand_nearest, paths
from strandloom.plans.files import _text, _xml
from strandloom.plans.registry import Tables, query
from strandloom.sources import rdf


def _ontology(t: Tables) -> str:
    """Nations as classes of an ontology: subclasses of their regions, parts of them by a restriction, every fifth one deprecated; and a property."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    about = lambda kind, x: F.concat(F.lit(f'<owl:{kind} rdf:about="http://x.org/obo/XX_'), x.cast("string"), F.lit('">'))
    restriction = _text('<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x.org/obo/so#part_of"/><owl:someValuesFrom rdf:resource="http://x.org/obo/YY_', r, '"/></owl:Restriction></rdfs:subClassOf>')
    label, gone = F.when(k % 3 > 0, _text("<rdfs:label>", F.col("n_name"), "</rdfs:label>")).otherwise(""), F.when(k % 5 == 0, "<owl:deprecated>true</owl:deprecated>").otherwise("")
    linked = F.when(k % 2 == 0, _text('<obo:RO_0002202 rdf:resource="http://x.org/obo/XX_', k + 1, '"/>')).otherwise("")
    kind = lambda x: F.when(k % 4 == 0, _text(about("NamedIndividual", x), '<rdf:type rdf:resource="http://www.w3.org/2002/07/owl#Class"/></owl:NamedIndividual>')).otherwise("")
    line = F.concat(about("Class", k), F.lit('<rdfs:subClassOf rdf:resource="http://x.org/obo/YY_'), r.cast("string"), F.lit('"/>'), restriction, label, gone, linked, F.lit("</owl:Class>"), kind(k), F.when(k == 1, '<owl:ObjectProperty rdf:about="http://x.org/obo/so#part_of"/>').otherwise(""))
    return _xml(t.nation.select(line), "ontology")


@query("""
SELECT 'XX:' || n_nationkey AS curie, 'Class' AS entity_type, CASE WHEN n_nationkey % 3 > 0 THEN n_name ELSE 'XX:' || n_nationkey END AS term FROM nation WHERE n_nationkey % 5 > 0
UNION ALL SELECT 'so#part_of', 'ObjectProperty', 'part_of'""")
def owl_entities(t: Tables):
    """Entities with their types by priority, without deprecated ones."""
    return rdf.read_entities(t.spark, _ontology(t)).select("curie", "entity_type", "term")


@query("""
SELECT 'XX:' || n_nationkey AS subject, 'subClassOf' AS predicate, 'YY:' || n_regionkey AS object FROM nation WHERE n_nationkey % 5 > 0
UNION ALL SELECT 'XX:' || n_nationkey, 'so#part_of', 'YY:' || n_regionkey FROM nation WHERE n_nationkey % 5 > 0
UNION ALL SELECT 'XX:' || n_nationkey, 'RO:0002202', 'XX:' || (n_nationkey + 1) FROM nation WHERE n_nationkey % 5 > 0 AND n_nationkey % 2 = 0
UNION ALL SELECT 'XX:' || n_nationkey, 'type', 'owl#Class' FROM nation WHERE n_nationkey % 5 > 0 AND n_nationkey % 4 = 0""")
def owl_edges(t: Tables):
    """Triples; restrictions are followed through their blank nodes to what they hold."""
    triples = rdf.read_triples(t.spark, _ontology(t), ("obo:RO_0002202",))
    blank = triples.where("predicate = 'has_restriction'").select("subject", F.col("object").alias("blank"))
    held = triples.join(blank.withColumnRenamed("subject", "who"), triples["subject"] == F.col("blank")).select(F.col("who").alias("subject"), "predicate", "object")
    return triples.where("object_kind = 'iri' AND NOT startswith(subject, '_:')").select("subject", "predicate", "object").unionByName(held)


def _edges(t: Tables):
    """customer in nation, supplier in nation, nation in region, order by customer."""
    edge = lambda df, a, x, p, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("subject"), F.lit(p).alias("predicate"), F.concat(F.lit(b), F.col(y).cast("string")).alias("object"))
    parts = [edge(t.customer, "c", "c_custkey", "in", "n", "c_nationkey"), edge(t.supplier, "s", "s_suppkey", "in", "n", "s_nationkey"), edge(t.nation, "n", "n_nationkey", "in", "r", "n_regionkey"), edge(t.orders, "o", "o_orderkey", "by", "c", "o_custkey")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""
WITH e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
one AS (SELECT DISTINCT b AS start, a AS node, 1 AS hops FROM e WHERE b IN ('r0', 'r1')),
two AS (SELECT DISTINCT start, e.a AS node, 2 AS hops FROM one JOIN e ON e.b = one.node),
ends AS (SELECT start, node, min(hops) AS hops FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2)
SELECT start, 'o' || o_orderkey AS node, CAST(min(hops) + 1 AS INTEGER) AS hops FROM ends JOIN orders ON node = 'c' || o_custkey GROUP BY 1, 2""")
def path_patterns(t: Tables):
    """Orders by customers who are, in one or two steps, in the first two regions."""
    starts = t.region.where("r_regionkey < 2").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    found = paths(_edges(t), starts, [Step(("in",), backward=True, least=1, most=2), Step(("by",), backward=True)])
    return found.select("start", "node", F.size("path").alias("hops"))


@query("""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS s FROM embeddings, q ORDER BY 3 DESC, vec_id LIMIT 5),
led AS (SELECT 'v' || vec_id AS node, 0 AS hops, s FROM near UNION ALL SELECT 'l' || label, 1, s FROM near UNION ALL SELECT 'v' || v.vec_id, 2, s FROM near JOIN embeddings v USING (label) WHERE v.vec_id <> near.vec_id)
SELECT node, CAST(arg_min(hops, (-s, hops)) AS INTEGER) AS hops, round(max(s), 5) AS similarity FROM led GROUP BY node""")
def nearest_then_related(t: Tables):
    """The nearest vectors, their labels, and what has the same labels."""
    near = rag.nearest(t.embeddings, t.embeddings.where("vec_id = 0").first()["embedding"], 5).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), "similarity")
    edges = t.embeddings.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("subject"), F.lit("has").alias("predicate"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("object"))
    one = expand_nearest(near, edges, [Step(("has",))])
    two = expand_nearest(near, edges, [Step(("has",)), Step(("has",), backward=True)])
    both = one.unionByName(two)
    best = both.groupBy("node").agg(F.max_by("hops", F.struct("similarity", -F.col("hops"))).alias("hops"), F.max("similarity").alias("similarity"))
    return best.select("node", "hops", F.round("similarity", 5).alias("similarity"))
