"""Genes made from customers, variants from parts, QTLs and hits from lineitem, and lookups over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import records
from strandloom.plans.registry import Tables, query

_GENES = "SELECT 'ENSG' || c_custkey AS gene_id, 'G' || c_nationkey || '-' || c_custkey AS symbol, CAST(10000 + c_custkey AS VARCHAR) AS entrez_id, 'chr' || (c_custkey % 22 + 1) AS chromosome, CAST(c_custkey AS BIGINT) * 1000 AS s, CAST(c_custkey AS BIGINT) * 1000 + 400 + c_custkey % 7 * 300 AS e FROM customer"
_ALLELES = "CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AC' ELSE 'G' END", "CASE p_size % 2 WHEN 0 THEN 'T' ELSE 'TGA' END"
_VARIANTS = f"SELECT p_partkey, (p_partkey % 22 + 1) || ':' || p_partkey * 500 || ':' || {_ALLELES[0]} || ':' || {_ALLELES[1]} AS variant_id, CASE WHEN p_partkey % 4 > 0 THEN 'rs' || p_partkey END AS ref_snp_id, 'chr' || (p_partkey % 22 + 1) AS chromosome, CAST(p_partkey AS BIGINT) * 500 AS position, length({_ALLELES[0]}) AS length FROM part"


def _genes(t: Tables):
    k = F.col("c_custkey")
    start = k.cast("long") * 1000
    return t.customer.select(F.concat(F.lit("ENSG"), k.cast("string")).alias("gene_id"), F.concat_ws("-", F.concat(F.lit("G"), F.col("c_nationkey").cast("string")), k.cast("string")).alias("symbol"), (k + 10000).cast("string").alias("entrez_id"), F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chromosome"), start.alias("start"), (start + 400 + k % 7 * 300).alias("end"))


def _variants(t: Tables):
    k = F.col("p_partkey")
    ref = F.when(k % 3 == 0, "A").when(k % 3 == 1, "AC").otherwise("G")
    alt = F.when(F.col("p_size") % 2 == 0, "T").otherwise("TGA")
    at = k.cast("long") * 500
    return t.part.select("p_partkey", F.concat_ws(":", (k % 22 + 1).cast("string"), at.cast("string"), ref, alt).alias("variant_id"), F.when(k % 4 > 0, F.concat(F.lit("rs"), k.cast("string"))).alias("ref_snp_id"), F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chromosome"), at.alias("position"), F.length(ref).alias("length"))


def _store(t: Tables) -> records.Store:
    hits = t.lineitem.select(F.concat(F.lit("T"), (F.col("l_suppkey") % 40).cast("string")).alias("track_id"), F.concat(F.lit("chr"), (F.col("l_partkey") % 22 + 1).cast("string")).alias("chromosome"), (F.col("l_orderkey").cast("long") * 10).alias("start"), (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber") * 40).alias("end"), "l_orderkey", "l_linenumber")
    tracks = t.supplier.select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("track_id"), F.col("s_name").alias("name"))
    assoc = t.orders.select(F.concat(F.lit("ENSG"), F.col("o_custkey").cast("string")).alias("gene_id"), (F.col("o_totalprice") / 1e9).alias("p_value"), "o_orderkey")
    return records.Store(_genes(t), _variants(t), tracks, hits, assoc)


_HITS = "SELECT 'T' || (l_suppkey % 40) AS track_id, 'chr' || (l_partkey % 22 + 1) AS chromosome, CAST(l_orderkey AS BIGINT) * 10 AS s, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber * 40 AS e, l_orderkey, l_linenumber FROM lineitem"

#: Each customer's key is a symbol, an Ensembl id, an Entrez id, a region, three kinds of variants, or nothing that is known.
_KEYS = "SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'g' || c_nationkey || '-' || c_custkey WHEN 1 THEN 'ENSG' || c_custkey WHEN 2 THEN CAST(10000 + c_custkey AS VARCHAR) WHEN 3 THEN (c_custkey % 30) || ':' || c_custkey || '-' || (c_custkey + 900) WHEN 4 THEN 'chrX-' || c_custkey || '-' || (c_custkey + 900) WHEN 5 THEN 'chr2:' || (c_custkey + 1) || '-' || c_custkey WHEN 6 THEN 'RS' || c_custkey WHEN 7 THEN (c_custkey % 22 + 1) || ':' || c_custkey * 500 || ':T:A' ELSE 'dup_chr1_4ae4cdb8' END AS key FROM customer"


def _keys(t: Tables):
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    to = (k + 900).cast("string")
    m = k % 9
    key = (
        F.when(m == 0, F.concat(F.lit("g"), F.col("c_nationkey").cast("string"), F.lit("-"), text))
        .when(m == 1, F.concat(F.lit("ENSG"), text))
        .when(m == 2, (k + 10000).cast("string"))
        .when(m == 3, F.concat((k % 30).cast("string"), F.lit(":"), text, F.lit("-"), to))
        .when(m == 4, F.concat(F.lit("chrX-"), text, F.lit("-"), to))
        .when(m == 5, F.concat(F.lit("chr2:"), (k + 1).cast("string"), F.lit("-"), text))
        .when(m == 6, F.concat(F.lit("RS"), text))
        .when(m == 7, F.concat((k % 22 + 1).cast("string"), F.lit(":"), (k.cast("long") * 500).cast("string"), F.lit(":T:A")))
        .otherwise("dup_chr1_4ae4cdb8")
    )
    return t.customer.select("c_custkey", key.alias("key"))


@query(f"""
SELECT c_custkey, CASE WHEN m IN (3, 4) AND (m = 4 OR c_custkey % 30 BETWEEN 1 AND 22) THEN 'region' WHEN m IN (6, 7, 8) THEN 'variant' WHEN m IN (0, 1) OR (m = 2 AND length(key) = 5) THEN 'gene' END AS kind,
  CASE WHEN m = 3 AND c_custkey % 30 BETWEEN 1 AND 22 THEN 'chr' || key WHEN m = 4 THEN 'chrX:' || c_custkey || '-' || (c_custkey + 900) WHEN m = 6 THEN lower(key) WHEN m = 8 THEN upper(key) WHEN m = 7 OR m IN (0, 1) OR (m = 2 AND length(key) = 5) THEN key END AS id,
  CASE WHEN m = 4 OR (m = 3 AND c_custkey % 30 BETWEEN 1 AND 22) THEN CAST(c_custkey AS BIGINT) END AS start
FROM (SELECT *, c_custkey % 9 AS m FROM ({_KEYS}))""")
def loc_infer(t: Tables):
    return _keys(t).select("c_custkey", records.infer_location(F.col("key")).alias("l")).select("c_custkey", "l.kind", "l.id", "l.start")


@query(f"SELECT c_custkey, c_custkey % 9 IN (6, 7, 8) AS is_variant, CASE WHEN c_custkey % 9 NOT IN (6, 7, 8) THEN key || ': no variant; write a refSNP id, a structural id or chr:pos:ref:alt' END AS message FROM ({_KEYS})")
def feature_validation(t: Tables):
    message = records.feature_errors(F.col("key"), records.VARIANT)
    return _keys(t).select("c_custkey", message.isNull().alias("is_variant"), message.alias("message"))


@query(f"SELECT k.key, g.gene_id, g.chromosome, g.s AS start, g.e AS \"end\" FROM (SELECT DISTINCT key FROM ({_KEYS})) k JOIN ({_GENES}) g ON upper(g.symbol) = upper(k.key) OR g.gene_id = k.key OR g.entrez_id = k.key")
def gene_location(t: Tables):
    return records.gene_matches(_keys(t), _genes(t)).select("key", "gene_id", "chromosome", "start", "end")


@query(f"""
WITH k AS (SELECT DISTINCT key, regexp_replace(key, '^(.+):(.+):(.+):(.+)$', '\\1:\\2:\\4:\\3') AS other FROM ({_KEYS})),
p AS (SELECT k.key, v.variant_id, FALSE AS swapped FROM k JOIN ({_VARIANTS}) v ON v.variant_id = k.key OR v.ref_snp_id = lower(k.key))
SELECT * FROM p UNION ALL SELECT k.key, v.variant_id, TRUE FROM k JOIN ({_VARIANTS}) v ON v.variant_id = k.other AND k.other <> k.key WHERE k.key NOT IN (SELECT key FROM p)""")
def variant_keys(t: Tables):
    return records.variant_matches(_keys(t), _variants(t)).select("key", "variant_id", "swapped")


@query(f"""
WITH k AS (SELECT DISTINCT key, c_custkey, c_custkey % 9 AS m, regexp_replace(key, '^(.+):(.+):(.+):(.+)$', '\\1:\\2:\\4:\\3') AS other FROM ({_KEYS}) WHERE c_custkey % 9 <> 8),
hit AS (
  SELECT key, 'region' AS kind, CASE WHEN m = 4 THEN 'chrX' ELSE 'chr' || (c_custkey % 30) END AS chromosome, CAST(c_custkey AS BIGINT) AS s, CAST(c_custkey + 900 AS BIGINT) AS e FROM k WHERE m = 4 OR (m = 3 AND c_custkey % 30 BETWEEN 1 AND 22)
  UNION ALL SELECT k.key, 'gene', g.chromosome, g.s, g.e FROM k JOIN ({_GENES}) g ON (m = 0 AND upper(g.symbol) = upper(k.key)) OR (m = 1 AND g.gene_id = k.key) OR (m = 2 AND length(k.key) = 5 AND g.entrez_id = k.key)
  UNION ALL SELECT k.key, 'variant', v.chromosome, v.position, v.position + v.length FROM k JOIN ({_VARIANTS}) v ON (m = 6 AND v.ref_snp_id = lower(k.key)) OR (m = 7 AND v.variant_id = k.other))
SELECT k.key, hit.kind, hit.chromosome, hit.s AS start, hit.e AS "end" FROM (SELECT DISTINCT key FROM ({_KEYS})) k LEFT JOIN hit ON hit.key = k.key""")
def feature_lookup(t: Tables):
    return records.locations(_keys(t), _genes(t), _variants(t))


@query(f"SELECT 'N' || n_nationkey AS key, g.gene_id, CASE WHEN g.s >= lo AND g.e <= hi THEN 'in range' WHEN g.s < lo AND g.e > hi THEN 'contains range' WHEN g.s < lo THEN 'overlaps start' ELSE 'overlaps end' END AS relation FROM (SELECT n_nationkey, 'chr' || (n_nationkey % 22 + 1) AS c, CAST(n_nationkey AS BIGINT) * 9000 + 100 AS lo, CAST(n_nationkey AS BIGINT) * 9000 + 150000 AS hi FROM nation) r JOIN ({_GENES}) g ON g.chromosome = r.c AND g.s <= hi AND g.e >= lo")
def region_features(t: Tables):
    k = F.col("n_nationkey")
    asked = t.nation.select(F.concat(F.lit("N"), k.cast("string")).alias("key"), F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chromosome"), (k.cast("long") * 9000 + 100).alias("start"), (k.cast("long") * 9000 + 150000).alias("end"))
    return records.in_regions(asked, _genes(t)).select("key", "gene_id", "relation")


@query(f"SELECT gene_id, symbol, entrez_id, chromosome, s AS start, e AS \"end\" FROM ({_GENES}) WHERE upper(symbol) = (SELECT upper('g' || c_nationkey || '-' || c_custkey) FROM customer WHERE c_custkey = 7)")
def gene_by_id(t: Tables):
    nation = t.customer.where("c_custkey = 7").first()["c_nationkey"]
    return _store(t).gene(f"g{nation}-7")


@query(f"SELECT p_partkey, variant_id, ref_snp_id, chromosome, position, length, FALSE AS swapped FROM ({_VARIANTS}) WHERE ref_snp_id = 'rs11'")
def variant_by_id(t: Tables):
    return _store(t).variant("RS11")


@query(f"SELECT gene_id, symbol, CASE WHEN s >= 5000 AND e <= 90000 THEN 'in range' WHEN s < 5000 AND e > 90000 THEN 'contains range' WHEN s < 5000 THEN 'overlaps start' ELSE 'overlaps end' END AS relation FROM ({_GENES}) WHERE chromosome = 'chr3' AND s <= 90000 AND e >= 5000")
def region_by_span(t: Tables):
    return _store(t).region("3:5000-90000").select("gene_id", "symbol", "relation")


@query("SELECT v.id AS track_id, s_name AS name, s_name IS NOT NULL AS found FROM (VALUES ('T3'), ('T9'), ('T0')) v(id) LEFT JOIN supplier ON 'T' || s_suppkey = v.id")
def tracks_by_id(t: Tables):
    return _store(t).track("T3", "T9", "T0", "T3")


@query(f"SELECT track_id, l_orderkey, l_linenumber FROM ({_HITS}) WHERE chromosome = 'chr5' AND s <= 90000 AND e >= 2000 AND track_id IN ('T3', 'T9')")
def track_hits(t: Tables):
    return _store(t).track_hits("chr5:2000-90000", "T3", "T9").select("track_id", "l_orderkey", "l_linenumber")


@query(f"SELECT track_id, count(*) AS num_overlaps FROM ({_HITS}) WHERE chromosome = 'chr5' AND s <= 90000 AND e >= 2000 GROUP BY 1")
def informative_in_span(t: Tables):
    return _store(t).informative("chr5:2000-90000")


@query("SELECT 'ENSG' || o_custkey AS gene_id, o_totalprice / 1e9 AS p_value, o_orderkey FROM orders WHERE o_custkey = 10")
def gene_association_page(t: Tables):
    return _store(t).gene_associations("ENSG10")


_SEARCHED = "SELECT 'gene' AS record_type, gene_id AS id, symbol AS display FROM ({g}) WHERE chromosome = 'chr3' AND s <= {e} AND e >= {s} UNION ALL SELECT 'variant', variant_id, coalesce(ref_snp_id, variant_id) FROM ({v}) WHERE chromosome = 'chr3' AND position <= {e} AND position + length >= {s}"


@query(f"SELECT *, count(*) OVER () AS num_results FROM ({_SEARCHED.format(g=_GENES, v=_VARIANTS, s=5000, e=900000)}) ORDER BY record_type, display, id LIMIT 5")
def search_limited(t: Tables):
    return _store(t).search("chr3:5000-900000", 5)


@query(f"SELECT *, count(*) OVER () AS num_results FROM ({_SEARCHED.format(g=_GENES, v=_VARIANTS, s=1500, e=60000)})")
def search_region(t: Tables):
    """Genes and variants of a region."""
    return _store(t).search("3:1500-60000")


@query(f"SELECT 'variant' AS record_type, variant_id AS id, 'rs11' AS display, count(*) OVER () AS num_results FROM ({_VARIANTS}) WHERE ref_snp_id = 'rs11'")
def search_name(t: Tables):
    return _store(t).search("RS11")


@query(f"SELECT variant_id, split_part(variant_id, ':', 1) || ':' || (position - 1) || '-' || position AS span FROM ({_VARIANTS})")
def variant_qtl_span(t: Tables):
    return _variants(t).select("variant_id", records.variant_span(F.col("variant_id")).alias("span"))


def _consequences(t: Tables):
    k = F.col("p_partkey")
    gene = F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("ENSG"), (k % 4000).cast("string")))
    return _variants(t).select("*", F.when(k % 3 == 0, "SNV").otherwise("DEL").alias("variant_class"), F.when(k % 2 == 0, k % 4 == 0).alias("is_adsp_variant"), F.when(k % 7 == 0, "stop_gained").otherwise("intron_variant").alias("consequence"), F.lit("HIGH").alias("impact"), gene.alias("impacted_gene"), (k % 7 == 0).alias("is_coding"))


_DETAILS = f"SELECT v.*, CASE p_partkey % 3 WHEN 0 THEN 'SNV' ELSE 'DEL' END AS type, p_partkey % 4 = 0 AS is_adsp_variant, CASE p_partkey % 7 WHEN 0 THEN 'stop_gained' ELSE 'intron_variant' END AS consequence, g.symbol AS gene_symbol FROM ({_VARIANTS}) v LEFT JOIN ({_GENES}) g ON p_partkey % 5 <> 0 AND g.gene_id = 'ENSG' || (p_partkey % 4000)"


@query(f"SELECT variant_id, ref_snp_id, type, is_adsp_variant, consequence, gene_symbol FROM ({_DETAILS})")
def variant_details(t: Tables):
    d = records.variant_details(_consequences(t), _genes(t))
    return d.select("variant_id", "details.ref_snp_id", "details.type", "details.is_adsp_variant", "details.most_severe_consequence.consequence", F.col("details.most_severe_consequence.impacted_gene.gene_symbol").alias("gene_symbol"))


@query(f"""
SELECT 'T' || (l_suppkey % 40) AS track_id, l_orderkey, l_linenumber, g.symbol AS target_symbol, d.type AS variant_type,
  CASE WHEN split_part(d.variant_id, ':', 4) = CASE l_linenumber % 2 WHEN 0 THEN 'T' ELSE 'A' END THEN d.variant_id ELSE split_part(d.variant_id, ':', 1) || ':' || split_part(d.variant_id, ':', 2) || ':' || split_part(d.variant_id, ':', 4) || ':' || split_part(d.variant_id, ':', 3) END AS variant_id
FROM lineitem JOIN ({_DETAILS}) d ON d.p_partkey = l_partkey JOIN ({_GENES}) g ON g.gene_id = 'ENSG' || l_suppkey""")
def qtl_rows(t: Tables):
    ids = _variants(t).select("p_partkey", "variant_id")
    qtls = t.lineitem.join(ids, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("T"), (F.col("l_suppkey") % 40).cast("string")).alias("track_id"), "l_orderkey", "l_linenumber", "variant_id", F.when(F.col("l_linenumber") % 2 == 0, "T").otherwise("A").alias("test_allele"), F.concat(F.lit("ENSG"), F.col("l_suppkey").cast("string")).alias("target"))
    rows = records.qtl_rows(qtls, _genes(t), records.variant_details(_consequences(t), _genes(t)))
    return rows.select("track_id", "l_orderkey", "l_linenumber", F.col("target_gene.gene_symbol").alias("target_symbol"), F.col("details.type").alias("variant_type"), "variant_id")


_NEAR = "SELECT n_nationkey, 'N' || n_nationkey AS key, 'chr' || (n_nationkey % 22 + 1) AS c, CAST(n_nationkey AS BIGINT) * 9000 + 100 AS lo, CAST(n_nationkey AS BIGINT) * 9000 + 150000 AS hi FROM nation"


@query(f"SELECT 'adsp' AS resource, key, variant_id FROM ({_NEAR}) JOIN ({_VARIANTS}) v ON v.chromosome = c AND v.position <= hi AND v.position + v.length - 1 >= lo WHERE p_partkey % 4 = 0 UNION ALL SELECT 'dbsnp', key, variant_id FROM ({_NEAR}) JOIN ({_VARIANTS}) v ON v.chromosome = c AND v.position <= hi AND v.position + v.length - 1 >= lo WHERE ref_snp_id IS NOT NULL")
def variant_lists(t: Tables):
    k = F.col("n_nationkey")
    asked = t.nation.select(F.concat(F.lit("N"), k.cast("string")).alias("key"), F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chromosome"), (k.cast("long") * 9000 + 100).alias("start"), (k.cast("long") * 9000 + 150000).alias("end"))
    of = lambda name: records.variant_list(asked, _consequences(t), name).select(F.lit(name).alias("resource"), "key", "variant_id")
    return of("adsp").unionByName(of("dbsnp"))
