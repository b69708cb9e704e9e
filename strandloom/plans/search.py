"""Searches: the filter language, keywords, categories, site search, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import filters, gwas, paging, text_index
from strandloom.operators.metadata import browser_config, shard_url
from strandloom.operators.ordering import places
from strandloom.plans.registry import ORACLE_SQL, Tables, query

_PART = {"brand": "p_brand", "type": "p_type", "size": "p_size", "name": "p_name"}
_DOC = {"lang": "lang", "source": "source"}


@query("SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'standard' OR p_type ILIKE 'STANDARD'")
def filter_eq(t: Tables):
    return t.part.where(filters.condition("type eq standard", _PART)).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_type FROM part WHERE NOT (p_type ILIKE 'standard')")
def filter_neq(t: Tables):
    return t.part.where(filters.condition("type neq standard", _PART)).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%'")
def filter_like(t: Tables):
    return t.part.where(filters.condition("name like re", _PART)).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE NOT (p_name ILIKE '%re%')")
def filter_not_like(t: Tables):
    return t.part.where(filters.condition("name not like re", _PART)).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size <= 30")
def filter_cmp(t: Tables):
    return t.part.where(filters.condition("size gt 10 and size lte 30", _PART)).select("p_partkey", "p_size")


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)the[a-z]+ and')")
def keyword_regex(t: Tables):
    return t.documents.where(filters.keyword("text", "the[a-z]+ and")).select("doc_id", "lang")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice > 0 AND l_extendedprice / 1e8 <= 1e-4")
def pvalue_filter(t: Tables):
    rows = t.lineitem.where("l_extendedprice > 0").withColumn("score", -F.log10(F.col("l_extendedprice") / 1e8))
    return rows.where(filters.pvalue_at_most(F.col("score"), 1e-4)).select("l_orderkey", "l_linenumber")


_CATEGORY = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'AD' WHEN o_orderpriority = '2-HIGH' THEN 'Biomarker' WHEN o_orderpriority = '3-MEDIUM' THEN 'ADRD' ELSE 'Other' END"


def _orders_with_category(t: Tables):
    p = F.col("o_orderpriority")
    return t.orders.withColumn("category", F.when(p == "1-URGENT", "AD").when(p == "2-HIGH", "Biomarker").when(p == "3-MEDIUM", "ADRD").otherwise("Other"))


@query(f"SELECT o_orderkey, category FROM (SELECT *, {_CATEGORY} AS category FROM orders) WHERE category IN ('AD', 'Biomarker', 'ADRD')")
def trait_filter(t: Tables):
    return _orders_with_category(t).where(filters.trait_is(F.col("category"), "ALL_AD")).select("o_orderkey", "category")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')")
def source_filter(t: Tables):
    kind = F.when(F.col("source") == "src1", "summary statistics").when(F.col("source") == "src2", "curated")
    return t.documents.where(filters.source_is(kind, "ALL")).select("doc_id", "source")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name ILIKE '%n%1%' OR n_name = upper('n%1')")
def xdbref_lookup(t: Tables):
    return t.nation.where(filters.database_ref(F.col("n_name"), F.col("n_name"), "n%1")).select("n_nationkey", "n_name")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE lang = 'fr') AND source NOT IN ('src3') AND NOT starts_with(source, 'src1')")
def live_tracks(t: Tables):
    docs = t.documents.select("doc_id", F.col("source").alias("track_id"), F.col("source").alias("data_source"), "lang")
    return filters.only_live(docs, docs.where("lang = 'fr'"), ["src3"], ["src1"]).select("doc_id", F.col("track_id").alias("source"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang ILIKE 'en' AND source ILIKE '%src%' AND regexp_matches(text, '(?i)the') ORDER BY doc_id LIMIT 5000")
def track_search_e2e(t: Tables):
    found = t.documents.where(filters.condition("lang eq en and source like src", _DOC)).where(filters.keyword("text", "the"))
    return paging.page(found.select("doc_id", "lang", "source"), [F.col("doc_id")])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500 OFFSET 1000")
def page_offset(t: Tables):
    return paging.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 500)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank > 5 AND rank <= 10")
def rank_window(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return paging.rank_window(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5, 10).drop("l_extendedprice")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 10")
def top10_per_track(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return paging.rank_window(rows, ["l_suppkey"], [F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")], 0, 10).drop("l_quantity")


@query("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
u AS (SELECT *, sum(n) OVER (ORDER BY n DESC, event_type) AS upto FROM c)
SELECT event_type, CAST(greatest(0, 2000 - (upto - n)) AS BIGINT) AS first_row, CAST(least(n, 4000 - (upto - n)) AS BIGINT) AS end_row FROM u WHERE upto - n < 4000 AND upto > 2000""")
def page_cursor(t: Tables):
    return paging.page_slices(t.events.groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n", 1, 2000)


@query("""
SELECT record_type, id, display, match_rank FROM (
 SELECT 'customer' AS record_type, CAST(c_custkey AS VARCHAR) AS id, c_name AS display, 1 AS match_rank FROM customer WHERE c_name ILIKE 'customer#000000001'
 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name, 4 FROM customer WHERE c_name ILIKE '%00001%' AND NOT c_name ILIKE 'customer#000000001'
 UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, 4 FROM supplier WHERE s_name ILIKE '%00001%')""")
def site_search(t: Tables):
    def lookup(df, kind, key, name, exact, word):
        hit = F.ilike(F.col(name), F.lit(exact))
        return df.where(hit | F.ilike(F.col(name), F.lit(f"%{word}%"))).select(F.lit(kind).alias("record_type"), F.col(key).cast("string").alias("id"), F.col(name).alias("display"), F.when(hit, 1).otherwise(4).alias("match_rank"))

    found = lookup(t.customer, "customer", "c_custkey", "c_name", "customer#000000001", "00001").unionByName(lookup(t.supplier, "supplier", "s_suppkey", "s_name", "customer#000000001", "00001"))
    return found.orderBy("match_rank", "record_type", "display")


@query("SELECT page_id, regexp_replace(url || '/chr' || CAST(page_id % 22 + 1 AS VARCHAR) || '.bed', 'chr([0-9]{1,2}|[XYM]|MT)', '$CHR') AS url FROM pages")
def shard_url_template(t: Tables):
    url = F.concat("url", F.lit("/chr"), (F.col("page_id") % 22 + 1).cast("string"), F.lit(".bed"))
    return t.pages.select("page_id", shard_url(url).alias("url"))


@query("SELECT page_id, 'bed' AS format, CASE WHEN page_id % 2 = 0 THEN 'qtl' ELSE 'annotation' END AS type, url || '.tbi' AS index_url, page_id % 2 = 0 AS autoscale FROM pages")
def igv_config(t: Tables):
    schema = F.when(F.col("page_id") % 2 == 0, "bed|qtl").otherwise("bed")
    return t.pages.select("page_id", browser_config(schema, F.col("url")).alias("c")).select("page_id", "c.format", "c.type", "c.index_url", "c.autoscale")


@query("SELECT count(*) AS num_tracks FROM documents WHERE lang = 'de'")
def content_counts(t: Tables):
    return paging.project(t.documents.where("lang = 'de'"), "COUNTS", [])


@query("""
SELECT o.o_custkey, o.o_orderkey AS shard_id, r.root FROM orders o JOIN (SELECT o_custkey, min(o_orderkey) AS root FROM orders GROUP BY 1) r USING (o_custkey) WHERE o.o_orderkey <> r.root""")
def shard_expand(t: Tables):
    root = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("root"))
    return t.orders.join(root, "o_custkey").where("o_orderkey <> root").select("o_custkey", F.col("o_orderkey").alias("shard_id"), "root")


@query(f"SELECT o_orderkey, {_CATEGORY} AS category, row_number() OVER (PARTITION BY {_CATEGORY} ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_totalprice > 300000")
def best_by_category(t: Tables):
    rows = _orders_with_category(t).where("o_totalprice > 300000")
    return places(rows, ["category"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "category", "place")


@query("SELECT page_id, CASE WHEN lower(url) LIKE '%alzheimer%' THEN 'AD' WHEN lower(url) LIKE '%biomarker%' THEN 'Biomarker' WHEN regexp_matches(lower(url), 'dementia|parkinson|palsy') THEN 'ADRD' ELSE 'Other' END AS category FROM pages")
def trait_category(t: Tables):
    return t.pages.select("page_id", gwas.trait_category(F.col("url")).alias("category"))


@query(ORACLE_SQL["site_search"])
def indexed_site_search(t: Tables):
    """The site search by way of trigram indexes: only the texts that hold the word's trigrams are tested."""

    def lookup(df, kind, key, name, exact, word):
        found = text_index.build(df, key, name).contains(word)
        hit = F.ilike(F.col("text"), F.lit(exact))
        return found.select(F.lit(kind).alias("record_type"), F.col("id").cast("string").alias("id"), F.col("text").alias("display"), F.when(hit, 1).otherwise(4).alias("match_rank"))

    return lookup(t.customer, "customer", "c_custkey", "c_name", "customer#000000001", "00001").unionByName(lookup(t.supplier, "supplier", "s_suppkey", "s_name", "customer#000000001", "00001"))


@query(ORACLE_SQL["keyword_regex"])
def indexed_keyword_regex(t: Tables):
    found = text_index.build(t.documents, "doc_id", "text").matching("the[a-z]+ and", ignore_case=True)
    return t.documents.join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE 'G' || l_partkey = 'G15' OR CASE WHEN l_partkey % 2 = 0 THEN 'S' || l_suppkey END = 'G15'")
def impacted_gene(t: Tables):
    """Rows whose consequence is on a gene, by its id or symbol; some have no symbol."""
    gene = F.struct(F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("id"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("symbol"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.struct(gene.alias("gene")).alias("consequence"))
    return rows.where(filters.impacts_gene("consequence", "G15")).select("l_orderkey", "l_linenumber")
