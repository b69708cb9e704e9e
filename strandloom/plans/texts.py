"""Text records over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import rag, vector_index
from strandloom.plans.registry import Tables, query

_STOP = ", ".join(f"'{w}'" for w in rag.STOPWORDS)


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9\\-]+')) AS token FROM documents) WHERE length(token) > 1 AND token NOT IN ({_STOP}) GROUP BY 1")
def tokenize_freq(t: Tables):
    return t.documents.select(F.explode(rag.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT doc_id, upper(sha256(text)) AS digest FROM documents")
def text_hash(t: Tables):
    return t.documents.select("doc_id", F.hex(rag.text_hash(F.col("text"))).alias("digest"))


_SENTENCES = r"list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(CASE WHEN text IS NULL THEN NULL WHEN len(s) = 0 THEN 0 ELSE list_reduce(list_transform(s, lambda x: {{'n': 1, 'now': length(x)}}), lambda a, x: CASE WHEN a.now + x.now + 1 > 2000 THEN {{'n': a.n + 1, 'now': x.now}} ELSE {{'n': a.n, 'now': a.now + x.now + 1}} END).n END AS INTEGER) AS n_chunks FROM (SELECT doc_id, text, {_SENTENCES} AS s FROM documents)")
def chunk_counts(t: Tables):
    """Sentence chunks of each document, packed greedily."""
    pieces = rag.chunks(rag.sentences(F.col("text")))
    return t.documents.select("doc_id", F.size(pieces).alias("n_chunks"))


@query("""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 5) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, vec_id LIMIT 25""")
def knn_cosine(t: Tables):
    query_vector = t.embeddings.where("vec_id = 0").first()["embedding"]
    return rag.nearest(t.embeddings, query_vector, 25).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_type WHEN p_size % 4 = 1 THEN p_name WHEN p_size % 4 = 2 THEN p_type ELSE p_name || ' and much more than that in words' END AS definition FROM part")
def definition_merge(t: Tables):
    k = F.col("p_size") % 4
    old = F.when(k == 0, F.lit(None)).otherwise(F.col("p_name"))
    new = F.when(k == 3, F.concat("p_name", F.lit(" and much more than that in words"))).when(k == 1, F.col("p_name")).otherwise(F.col("p_type"))
    return t.part.select("p_partkey", rag.merged_definition(old, new, k.isin(2, 3)).alias("definition"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([p_name, p_type, p_brand, p_type])), '|') AS synonyms FROM part")
def synonym_union(t: Tables):
    merged = rag.merged_synonyms(F.array("p_name", "p_type"), F.array("p_brand", "p_type"))
    return t.part.select("p_partkey", F.array_join(merged, "|").alias("synonyms"))


@query("SELECT r_regionkey, 'Term: ' || r_name || chr(10) || 'CURIE: R:' || r_regionkey || chr(10) || 'Synonym: ' || lower(r_name) AS text FROM region")
def ontology_chunk(t: Tables):
    none = F.lit(None).cast("string")
    curie = F.concat(F.lit("R:"), F.col("r_regionkey").cast("string"))
    return t.region.select("r_regionkey", rag.ontology_text(F.col("r_name"), none, curie, none, F.array(F.lower("r_name")), none).alias("text"))


@query("SELECT DISTINCT subject, 'subClassOf' AS predicate, object FROM (SELECT n_name AS subject, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def csv_triples(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "right").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rag.triples(rows.select(F.col("r_name").alias("class"), F.col("n_name").alias("subclass"), F.col("c_name").alias("term")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT 9000000, 'added'")
def term_upsert(t: Tables):
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    new = t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("value"), F.lit(1).alias("line"))
    extra = t.spark.createDataFrame([(9000000, "added", 2), (9000000, "late", 3)], "id long, value string, line int")
    return rag.upsert(old, new.unionByName(extra), "id")


_NEAREST = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS c FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(c, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s) WHERE rank <= 10"""


def _asked(t: Tables):
    return t.embeddings.where(F.col("vec_id") % 50 == 0)


@query(_NEAREST)
def vector_index_exact(t: Tables):
    """The ten nearest rows of every fiftieth one, all lists asked: nothing is missed."""
    index = vector_index.build(t.embeddings, "vec_id", "embedding")
    found = index.search(_asked(t), "vec_id", "embedding", 10, index.lists)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("SELECT true AS reached, true AS fewer_lists, count(*) AS n_queries FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(t: Tables):
    """With the probes that tuning on all of these queries finds, the recall is measured against the exact results."""
    index = vector_index.build(t.embeddings, "vec_id", "embedding")
    asked = _asked(t)
    probes, _ = index.tune(asked, "vec_id", "embedding", 10, recall=0.9, sample=1 << 30)
    search = lambda n: index.search(asked, "vec_id", "embedding", 10, n)
    share = vector_index.recall(search(probes), search(index.lists))
    return asked.agg(F.count("*").alias("n_queries")).select(F.lit(share >= 0.9).alias("reached"), F.lit(probes < index.lists).alias("fewer_lists"), "n_queries")
