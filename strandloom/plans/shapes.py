"""Shapes of results, page arithmetic and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import regions as R
from strandloom.functions import strings as S
from strandloom.functions import variants as V
from strandloom.operators import paging
from strandloom.operators import projections as P
from strandloom.operators import validation as D
from strandloom.plans.registry import Tables, query


def _tracks(t: Tables):
    """Parts as tracks with nested provenance and file properties."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    return t.part.where("p_size IS NOT NULL").select(
        k.alias("track_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.struct(F.col("p_brand").alias("data_source"), F.lit("2024").alias("release_date"), F.when(s % 3 == 0, F.array(F.lit(11), F.lit(12))).alias("pubmed_id")).alias("provenance"),
        F.struct(F.when(s % 2 == 0, F.concat(F.lit("https://x.org/"), k)).alias("url"), F.when(s % 5 > 0, F.lit("bed")).alias("file_format"), s.cast("long").alias("file_size"), F.when(s % 4 > 0, k).alias("md5sum")).alias("file_properties"),
        F.lit(7).alias("num_hits"),
        F.lit("kept inside").alias("notes"),
    )


@query("SELECT CAST(p_partkey AS VARCHAR) AS track_id, p_name AS name, p_brand AS data_source, CASE WHEN p_size % 2 = 0 THEN 'https://x.org/' || p_partkey END AS url, 7 AS num_hits FROM part WHERE p_size IS NOT NULL")
def abridged_tracks(t: Tables):
    return P.abridged(_tracks(t), ["track_id", "name", "data_source", "url"])


@query("SELECT c_custkey, c_name AS owner_name, c_nationkey AS place_nation FROM customer")
def flattened_record(t: Tables):
    """Structs by path; an excluded field goes, an ordered one comes first."""
    inner = T.StructType([T.StructField("name", T.StringType(), metadata={"order": 1}), T.StructField("secret", T.StringType(), metadata={"exclude": True})])
    schema = T.StructType([T.StructField("place", T.StructType([T.StructField("nation", T.LongType())])), T.StructField("owner", inner), T.StructField("c_custkey", T.LongType(), metadata={"order": 0})])
    rows = t.customer.select(F.struct(F.col("c_nationkey").cast("long").alias("nation")).alias("place"), F.struct(F.col("c_name").alias("name"), F.lit("x").alias("secret")).alias("owner"), F.col("c_custkey").cast("long").alias("c_custkey"))
    flat = P.flattened(rows.to(schema))
    assert flat.columns == ["c_custkey", "owner_name", "place_nation"]
    return flat


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def record_by_id(t: Tables):
    return P.by_id(t.customer, "c_custkey", 7, ["c_custkey", "c_name"])


@query("SELECT '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS items FROM nation")
def json_response(t: Tables):
    return P.json_array(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS track_id, 'dataset:' || p_partkey AS id, CAST(p_size AS BIGINT) AS size, CASE WHEN p_size % 4 > 0 THEN CAST(p_partkey AS VARCHAR) END AS checksum, CASE WHEN p_size % 2 = 0 THEN 'https://x.org/' || p_partkey END AS access FROM part WHERE p_size IS NOT NULL")
def file_views(t: Tables):
    v = _tracks(t).select("track_id", P.file_view(F.col("track_id"), F.col("name"), F.col("file_properties")).alias("v"))
    return v.select("track_id", "v.id", "v.size", F.get("v.checksums", F.lit(0))["checksum"].alias("checksum"), F.get("v.access_methods", F.lit(0))["access_url"].alias("access"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS track_id, p_brand AS publisher, CASE WHEN p_size % 3 = 0 THEN '11,12' END AS papers, 'AD,gene' AS subjects, CAST(p_size AS VARCHAR) AS sizes FROM part WHERE p_size IS NOT NULL")
def citation_views(t: Tables):
    c = F.col
    view = P.citation_view(c("track_id"), c("name"), c("description"), F.lit("gene"), F.array(F.lit("AD")), c("provenance"), c("file_properties"))
    v = _tracks(t).select("track_id", view.alias("v"))
    return v.select("track_id", "v.publisher", F.array_join(F.transform("v.relatedIdentifiers", lambda x: x["relatedIdentifier"]), ",").alias("papers"), F.array_join(F.transform("v.subjects", lambda x: x["subject"]), ",").alias("subjects"), "v.sizes")


@query("SELECT CAST(p_partkey AS VARCHAR) AS track_id, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 5 > 0 THEN 'bed' ELSE 'application/x-gzip' END END AS format, CASE WHEN p_size % 2 = 0 AND p_size > 0 THEN p_size || ' bytes' END AS size FROM part WHERE p_size IS NOT NULL")
def dataset_views(t: Tables):
    c = F.col
    v = _tracks(t).select("track_id", P.dataset_view(c("track_id"), c("name"), c("description"), c("provenance"), c("file_properties")).alias("v"))
    return v.select("track_id", F.get_json_object("v", "$.distribution.encodingFormat").alias("format"), F.get_json_object("v", "$.distribution.contentSize").alias("size"))


@query("SELECT o_orderkey, c_custkey AS customer_key, TRUE AS known FROM orders JOIN customer ON 'C' || o_custkey = 'C' || c_custkey AND c_acctbal > 0 UNION ALL SELECT o_orderkey, NULL, FALSE FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def keys_by_name(t: Tables):
    """Keys looked up by name in a join, and the names that aren't known."""
    names = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_custkey").alias("customer_key"))
    rows = t.orders.select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer"))
    found, missing = P.with_key(rows, names, "customer", "customer_key", "name")
    return found.select("o_orderkey", "customer_key", F.lit(True).alias("known")).unionByName(missing.select("o_orderkey", F.lit(None).cast(found.schema["customer_key"].dataType).alias("customer_key"), F.lit(False).alias("known")))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey <= 500 THEN greatest(1, ceil(c_custkey / 5.0)) END AS INTEGER) AS pages FROM customer")
def page_counts(t: Tables):
    """Pages of 5 rows for as many rows as each customer's number; null beyond the most pages that are served."""
    return t.customer.select("c_custkey", paging.page_count(F.col("c_custkey"), 5).alias("pages"))


@query("SELECT o_orderkey, o_totalprice <= 50000 AS within, CAST(o_orderkey + floor(o_totalprice) AS BIGINT) AS \"end\" FROM orders")
def span_guard(t: Tables):
    start, end = F.col("o_orderkey").cast("long"), (F.col("o_orderkey") + F.floor("o_totalprice")).cast("long")
    return t.orders.select("o_orderkey", R.within_limit(F.lit(0), F.col("o_totalprice")).alias("within"), end.alias("end")).where(start.isNotNull())


_REF, _ALT = "CASE p_size % 4 WHEN 0 THEN 'CAT' WHEN 1 THEN 'CA' WHEN 2 THEN 'A' ELSE 'GG' END", "CASE p_size % 4 WHEN 0 THEN 'CT' WHEN 1 THEN 'CAG' WHEN 2 THEN 'T' ELSE 'GG' END"


@query(f"SELECT p_partkey, {_REF} AS ref, {_ALT} AS alt, CASE p_size % 4 WHEN 0 THEN 'A/-' WHEN 1 THEN '-/G' WHEN 2 THEN 'A/T' ELSE '-/-' END AS normalised, CAST(p_partkey + CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 1 END AS BIGINT) AS \"end\" FROM part WHERE p_size IS NOT NULL")
def normalised_alleles(t: Tables):
    k = F.col("p_size") % 4
    ref, alt = F.when(k == 0, "CAT").when(k == 1, "CA").when(k == 2, "A").otherwise("GG"), F.when(k == 0, "CT").when(k == 1, "CAG").when(k == 2, "T").otherwise("GG")
    both = V.normalised_alleles(ref, alt)
    return t.part.where("p_size IS NOT NULL").select("p_partkey", ref.alias("ref"), alt.alias("alt"), F.concat_ws("/", both["ref"], both["alt"]).alias("normalised"), V.span_end(F.col("p_partkey").cast("long"), ref, alt).cast("long").alias("end"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (p_size % 22 + 1) || ':' || p_partkey || ':A:G' ELSE (p_size % 22 + 1) || ':' || p_partkey || ':A:GTT' END AS id, 'rs' || p_partkey AS snp FROM part WHERE p_size IS NOT NULL")
def variant_primary_keys(t: Tables):
    """Ids of single-base and short variants by their place; structural ones are digests, which the tests hold against Python's."""
    chrom = F.concat(F.lit("chr"), (F.col("p_size") % 22 + 1).cast("string"))
    key = V.primary_key(chrom, F.col("p_partkey").cast("long"), F.lit("A"), F.when(F.col("p_size") % 2 == 0, "G").otherwise("GTT"), F.lit("SQ.x"))
    snp = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("rs"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    return t.part.where("p_size IS NOT NULL").select("p_partkey", key.alias("id"), V.ref_snp(snp).alias("snp"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS text, chr(CAST(64 + page_id % 26 + 1 AS INTEGER)) AS letter FROM pages")
def sanitised_pages(t: Tables):
    return t.pages.select("page_id", S.sanitise(F.col("html")).alias("text"), S.int_to_alpha((F.col("page_id") % 26 + 1).cast("int")).alias("letter"))


@query("SELECT string_agg(n_name || '=' || n_nationkey, ';' ORDER BY n_name || '=' || n_nationkey) AS properties FROM nation")
def properties_file(t: Tables):
    """Key and value lines as one map."""
    lines = t.nation.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    return D.transposed(lines).select(S.info_string(F.col("properties")).alias("properties"))


@query("SELECT * FROM (VALUES ('required column `c_fax` is missing'), ('column `c_name` is not allowed')) v(message)")
def file_level_errors(t: Tables):
    found = D.file_errors({"required": ["c_custkey", "c_fax"], "additionalProperties": False, "properties": {"c_custkey": {}}}, t.customer.select("c_custkey", "c_name").columns)
    return t.spark.createDataFrame([(m,) for m in found], "message string")
