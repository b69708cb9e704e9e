"""Validation, templates, exports and load transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import metadata as M
from strandloom.operators import validation as D
from strandloom.operators.nested_validation import validate_nested
from strandloom.plans.registry import Tables, query
from strandloom.sources import genomic, tables

_SEGMENTS = ["building", "Automobile", "MACHINERY"]


@query("SELECT c_custkey, 'field `c_mktsegment` has the value ' || c_mktsegment || '; allowed: building, Automobile, MACHINERY' AS message FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'automobile', 'machinery')")
def enum_violations(t: Tables):
    return D.validate(t.customer.select("c_custkey", "c_mktsegment"), {"properties": {"c_mktsegment": {"enum": _SEGMENTS}}}, "c_custkey")


@query("SELECT conv_id, turn, 'required field `speaker` is empty' AS message FROM conversations WHERE role IS NULL OR role = 'user'")
def required_nulls(t: Tables):
    rows = t.conversations.withColumn("speaker", F.nullif("role", F.lit("user")))
    return rows.select("conv_id", "turn", F.explode(D.errors({"required": ["speaker"]}, ["speaker"])).alias("message"))


@query("SELECT doc_id, doc_id % 3 = 0 AS md5_ok, doc_id % 2 = 0 AS pubmed_ok FROM documents")
def format_checks(t: Tables):
    md5 = F.when(F.col("doc_id") % 3 == 0, F.md5("text")).otherwise("short")
    pm = F.when(F.col("doc_id") % 2 == 0, "PMID:12345678").otherwise("PMID:1")
    return t.documents.select("doc_id", D.format_ok(md5, "md5sum").alias("md5_ok"), D.format_ok(pm, "pubmed_id").alias("pubmed_ok"))


@query("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'building' WHEN 'automobile' THEN 'Automobile' ELSE c_mktsegment END AS segment FROM customer")
def enum_canonical(t: Tables):
    return t.customer.select("c_custkey", D.canonical(F.col("c_mktsegment"), _SEGMENTS).alias("segment"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'GRCh38' ELSE 'GRCh37' END AS build FROM documents")
def genome_build_map(t: Tables):
    return t.documents.select("doc_id", M.genome_build(F.when(F.col("doc_id") % 2 == 0, "hg38/GRCh38 lifted").otherwise("hg19")).alias("build"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'ChIP-seq' WHEN 3 THEN 'DNase-seq' WHEN 4 THEN 'RNA-seq' END AS assay, CASE p_size % 5 WHEN 0 THEN 'ChromHMM 15' WHEN 1 THEN 'annotation' WHEN 2 THEN 'eQTL' END AS analysis FROM part")
def assay_split(t: Tables):
    k = F.col("p_size") % 5
    assay = F.when(k == 0, "ChromHMM 15").when(k == 1, "Annotation").when(k == 2, "eQTL").when(k == 3, "DNase-Seq peaks").otherwise("RNA-Seq")
    return t.part.select("p_partkey", M.assay_and_analysis(assay, F.lit(None).cast("string")).alias("a")).select("p_partkey", "a.assay", "a.analysis")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a b' WHEN 2 THEN 'kept' ELSE p_name END AS value FROM part")
def template_clean(t: Tables):
    k = F.col("p_size") % 4
    text = F.when(k == 0, "Not applicable").when(k == 1, "a%20b").when(k == 2, "Not applicable; kept").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", M.clean_value(text).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'C' || o_custkey END AS cohort FROM orders")
def regex_capture(t: Tables):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x=1;cohort=C"), F.col("o_custkey").cast("string"), F.lit(";y=2"))).otherwise("x=1")
    return t.orders.select("o_orderkey", M.captured(text, r"cohort=([^;]+)").alias("cohort"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS gene_id, category, label, value FROM (SELECT c_custkey, 'nomenclature' AS category, 'symbol' AS label, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'identifier', 'uniprot_id', 'P' || c_custkey FROM customer UNION ALL SELECT c_custkey, 'identifier', 'uniprot_id', 'Q' || c_custkey FROM customer UNION ALL SELECT c_custkey, 'resource_link', 'omim_id', c_mktsegment FROM customer WHERE c_custkey % 2 = 0)")
def unpivot_xrefs(t: Tables):
    k = F.col("c_custkey").cast("string")
    wide = t.customer.select(k.alias("ensembl_gene_id"), F.col("c_name").alias("symbol"), F.array(F.concat(F.lit("P"), k), F.concat(F.lit("Q"), k)).alias("uniprot_ids"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("omim_id"), F.lit("x").alias("status"))
    return genomic.unpivot_xrefs(wide)


@query("SELECT DISTINCT 'ENSG' || (o_custkey % 500) AS gene FROM orders")
def strip_version_dedupe(t: Tables):
    versioned = F.concat(F.lit("ENSG"), (F.col("o_custkey") % 500).cast("string"), F.lit("."), (F.col("o_orderkey") % 9).cast("string"))
    return t.orders.select(genomic.strip_version(versioned).alias("gene")).distinct()


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY p_brand")
def unique_values(t: Tables):
    return tables.unique_values(t.part, "p_brand")


@query("SELECT n_regionkey, array_to_string(list_sort(list_distinct(list(n_name))), ',') AS names FROM nation GROUP BY 1")
def column_mapping(t: Tables):
    return tables.column_mapping(t.nation, "n_regionkey", "n_name").select("n_regionkey", F.array_join("values", ",").alias("names"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def export_filtered(t: Tables):
    return tables.filtered(t.orders, ["o_orderkey", "o_totalprice"], {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("SELECT c_custkey || chr(9) || c_name || chr(9) || coalesce(nullif(c_mktsegment, 'BUILDING'), 'NA') AS line FROM customer")
def to_text_rows(t: Tables):
    rows = t.customer.withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return rows.select(tables.text_row(["c_custkey", "c_name", "segment"]).alias("line"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS merged FROM events")
def merge_date_utc(t: Tables):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.events.select("event_id", genomic.utc(text).alias("merged"))


@query("SELECT p_partkey, 'ENCODE' AS source, CASE WHEN p_size % 2 = 0 THEN 'v' || p_size END AS version FROM part")
def source_version(t: Tables):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ENCODE_v"), F.col("p_size").cast("string"))).otherwise("ENCODE")
    return t.part.select("p_partkey", M.source_and_version(text).alias("s")).select("p_partkey", "s.*")


@query("SELECT p_partkey, 'bed' AS format, CASE p_size % 3 WHEN 0 THEN 'bed6' WHEN 1 THEN 'bed3+' ELSE 'bed4|narrowPeak' END AS schema FROM part")
def file_format(t: Tables):
    k = F.col("p_size") % 3
    text = F.when(k == 0, "bed6").when(k == 1, "bed bed3+").otherwise("bed bed4 narrowPeak")
    return t.part.select("p_partkey", M.format_and_schema(text).alias("f")).select("p_partkey", "f.*")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'track ' || p_partkey WHEN 1 THEN 'track ' || p_partkey ELSE 'f ' || p_partkey END AS name, CASE p_size % 4 WHEN 0 THEN 'track ' || p_partkey || ' (bed3+ file) more' WHEN 1 THEN 'track ' || p_partkey || ' [idr_peak) more' ELSE 'f ' || p_partkey END AS description FROM part WHERE p_size IS NOT NULL")
def track_names(t: Tables):
    k, n = F.col("p_size") % 4, F.col("p_partkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("track "), n, F.lit(" (bed3+ file) more"))).when(k == 1, F.concat(F.lit("track "), n, F.lit(" [idr_peak) more")))
    url = F.concat(F.lit("https://x.org/d/f_"), n, F.lit(".bed.gz"))
    return t.part.where("p_size IS NOT NULL").select("p_partkey", M.name_and_description(name, url).alias("n")).select("p_partkey", "n.*")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a b - c' || p_partkey WHEN 1 THEN 'neuron' END AS term, CASE p_size % 3 WHEN 0 THEN 'CL:' || p_partkey WHEN 1 THEN '#track-biosample:neuron' END AS curie, CASE WHEN p_size % 3 < 2 THEN 'cell line' END AS type, CASE WHEN p_size % 3 = 1 THEN '#track-tissue:brain' END AS tissue FROM part WHERE p_size IS NOT NULL")
def biosample_rules(t: Tables):
    k, n = F.col("p_size") % 3, F.col("p_partkey").cast("string")
    cell = F.when(k == 0, "12.5").when(k == 1, "neuron")
    made = M.biosample(cell, F.when(k == 0, F.concat(F.lit("CL:"), n)), F.when(k == 0, "Timecourse").otherwise("Immortalized cell line"), F.when(k == 1, "brain"), F.lit("nervous"), F.lit(None).cast("string"), F.concat(F.lit("a%20b:c"), n, F.lit(".x.bed")))
    b = t.part.where("p_size IS NOT NULL").select("p_partkey", made.alias("b"))
    return b.select("p_partkey", F.get("b.biosample", F.lit(0))["term"].alias("term"), F.get("b.biosample", F.lit(0))["curie"].alias("curie"), F.get("b.biosample_type", F.lit(0)).alias("type"), F.get("b.tissue", F.lit(0))["curie"].alias("tissue"))


#: assay, analysis, output type, classification, description, and what the features are.
_TRACK_KINDS = [
    ("eQTL", None, None, None, None, "eQTL"),
    ("TF ChIP-seq", None, "peaks", None, None, "transcription factor binding site"),
    ("ATAC-seq", None, "peaks", None, None, "chromatin accessibility"),
    (None, "annotation", "Gene models", None, None, "gene"),
    (None, "annotation", "other", None, "All lncRNA annotations", "lncRNA"),
    (None, "sQTL", None, None, None, "sQTL"),
    ("ChIP-seq", None, "peaks", "ChIP-seq CTCF clusters", None, "CTCF-binding site"),
    ("ChIP-seq", None, "peaks", "TF ChIP-seq peaks", None, "transcription factor binding site"),
    ("RNA-seq", None, "methylation state at CpG", None, None, "CpG methylation state"),
    ("RNA-seq", None, "TSS clusters", None, None, "transcription start site"),
    ("RNA-seq", None, "Chromatin interactions", None, None, "chromatin interactions"),
    ("RNA-seq", None, "clusters", None, None, None),
    ("RNA-seq", None, "footprints", None, None, "footprints"),
]


@query(f"SELECT c_custkey, {' '.join(['CASE c_custkey % 13', *(f'WHEN {k} THEN ' + (repr(r[5]) if r[5] else 'NULL') for k, r in enumerate(_TRACK_KINDS)), 'END'])} AS feature_type FROM customer")
def feature_types(t: Tables):
    kinds = t.spark.createDataFrame([(k, *r[:5]) for k, r in enumerate(_TRACK_KINDS)], "k long, assay string, analysis string, output_type string, classification string, description string")
    rows = t.customer.join(kinds, F.col("c_custkey") % 13 == F.col("k"))
    return rows.select("c_custkey", M.feature_type(*map(F.col, ("assay", "analysis", "output_type", "classification", "description"))).alias("feature_type"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'x pQTL INDEL' ELSE 'x pQTL pQTL INDEL' END AS text FROM part WHERE p_size IS NOT NULL")
def qtl_text(t: Tables):
    kind = F.when(F.col("p_size") % 2 == 0, "pQTL").otherwise("region")
    return t.part.where("p_size IS NOT NULL").select("p_partkey", M.without_repeated_type(F.lit("x pQTL pQTL INDEL"), kind).alias("text"))


@query("SELECT o_orderkey AS order_key, o_custkey AS technical_replicates, o_orderstatus AS antibody_target, o_totalprice AS md5sum FROM orders")
def template_keys(t: Tables):
    return M.clean_keys(t.orders.select(F.col("o_orderkey").alias("orderKey"), F.col("o_custkey").alias("technicalReplicate(s)"), F.col("o_orderstatus").alias("#Antibody"), F.col("o_totalprice").alias("Processed File MD5")))


#: Archives need a list of their files; a sample is named for files of one sample, and for no others.
_MANIFEST = {
    "definitions": {"filled": {"type": "string", "minLength": 1}},
    "properties": {"status": {"enum": ["F", "O", "P"]}},
    "allOf": [
        {"if": {"properties": {"file": {"pattern": r".+\.zip$"}}}, "then": {"properties": {"files": {"$ref": "#/definitions/filled"}}, "required": ["files"]}},
        {"if": {"properties": {"status": {"enum": ["F"]}}}, "then": {"properties": {"sample": {"$ref": "#/definitions/filled"}}}},
        {"if": {"properties": {"status": {"not": {"enum": ["F"]}}}}, "then": {"properties": {"sample": {"type": "null"}}}},
    ],
}


@query("""
WITH m AS (SELECT o_orderkey, 'f' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.zip' ELSE '.txt' END AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'list' END AS files, o_orderstatus AS status, CASE WHEN o_orderkey % 5 < 3 THEN 'S' || o_custkey END AS sample FROM orders)
SELECT o_orderkey, 'required field `files` is empty' AS message FROM m WHERE file LIKE '%.zip' AND files IS NULL
UNION ALL SELECT o_orderkey, 'field `files` is shorter than 1' FROM m WHERE file LIKE '%.zip' AND files IS NULL
UNION ALL SELECT o_orderkey, 'field `sample` is shorter than 1' FROM m WHERE status = 'F' AND sample IS NULL
UNION ALL SELECT o_orderkey, 'field `sample` must be empty, not ' || sample FROM m WHERE status <> 'F' AND sample IS NOT NULL""")
def conditional_rules(t: Tables):
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    rows = t.orders.select("o_orderkey", F.concat(F.lit("f"), n, F.when(k % 3 == 0, ".zip").otherwise(".txt")).alias("file"), F.when(k % 2 == 0, "list").alias("files"), F.col("o_orderstatus").alias("status"), F.when(k % 5 < 3, F.concat(F.lit("S"), F.col("o_custkey").cast("string"))).alias("sample"))
    return D.validate(rows, _MANIFEST, "o_orderkey")


@query("""
SELECT 'T' || p_partkey AS track_id, 'track ' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'GRCh38' ELSE 'GRCh37' END AS genome_build, CASE p_size % 3 WHEN 0 THEN 'eQTL' WHEN 1 THEN 'chromatin accessibility' ELSE 'peaks' END AS feature_type,
  p_size % 5 = 0 AS is_download_only, CASE WHEN p_size % 4 > 0 THEN 'cell' || p_size END AS term, CASE p_size % 3 WHEN 1 THEN 'ATAC-seq' WHEN 2 THEN 'RNA-seq' END AS assay, 'SRC' AS data_source, 'v' || p_size AS version,
  'https://here.org/d/f' || p_partkey || '.bed.gz' AS url, 'bed' AS format, CAST(p_partkey AS BIGINT) AS size
FROM part WHERE p_size IS NOT NULL""")
def track_records(t: Tables):
    """Records from a template."""
    k, s, n = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey").cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    template = t.part.where("p_size IS NOT NULL").select(
        text("T", n).alias("identifier"), text("track%20", n).alias("trackName"), F.when(s % 2 == 0, "hg38").otherwise("hg19").alias("Genome build"), F.when(s % 3 == 0, "eQTL").when(s % 3 == 1, "ATAC-Seq").otherwise("RNA-Seq").alias("assay"),
        F.lit("peaks").alias("Output type"), F.when(s % 5 == 0, "downloadOnly").otherwise("NA").alias("track type"), F.when(s % 4 > 0, text("cell", s)).otherwise("Not applicable").alias("cellType"), text("SRC_v", s).alias("Data Source"),
        text("wget https://there.org/x/data/d/f", n, ".bed.gz").alias("Processed file download url"), F.lit("bed bed3+").alias("File format"), n.alias("File size"), F.lit("abc").alias("Processed File MD5"),
    )
    r = M.track_records(template, "https://here.org", "data")
    return r.select("track_id", "name", "genome_build", "feature_type", "is_download_only", F.get("biosample_characteristics.biosample", F.lit(0))["term"].alias("term"), "experimental_design.assay", "provenance.data_source", F.col("provenance.data_source_version").alias("version"), "file_properties.url", F.col("file_properties.file_format").alias("format"), F.col("file_properties.file_size").alias("size"))


_NESTED = {"required": ["name"], "properties": {"name": {"minLength": 4}, "about": {"properties": {"size": {"type": "integer", "maximum": 40}, "words": {"contains": {"pattern": "^(red|blue)$"}, "items": {"maxLength": 5}}}}}, "if": {"properties": {"name": {"pattern": "^red"}}}, "then": {"properties": {"about": {"properties": {"size": {"minimum": 10}}}}}}


@query("""
WITH p AS (SELECT p_partkey, p_name, p_size, string_split(p_name, ' ') AS w FROM part),
m AS (
  SELECT p_partkey, unnest(list_filter([
    CASE WHEN length(p_name) < 4 THEN '$.name: shorter than 4' END, CASE WHEN p_size > 40 THEN '$.about.size: above 40' END,
    CASE WHEN NOT list_contains(w, 'red') AND NOT list_contains(w, 'blue') THEN '$.about.words: holds no item that it must' END,
    CASE WHEN p_name LIKE 'red%' AND p_size < 10 THEN '$.about.size: below 10' END], lambda x: x IS NOT NULL)
    || list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN length(w[i]) > 5 THEN '$.about.words[' || (i - 1) || ']: longer than 5' END), lambda x: x IS NOT NULL)) AS message FROM p)
SELECT p_partkey, message FROM m""")
def nested_schema(t: Tables):
    """Errors of nested records with their paths."""
    about = F.struct(F.col("p_size").alias("size"), F.split("p_name", " ").alias("words"))
    rows = t.part.select("p_partkey", F.struct(F.col("p_name").alias("name"), about.alias("about")).alias("record"))
    return validate_nested(rows, _NESTED, "p_partkey", "record")
