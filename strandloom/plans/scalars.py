"""Scalar functions over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import strings as S
from strandloom.functions import variants as V
from strandloom.operators import gwas
from strandloom.plans.registry import Tables, query

_BASES = "substr('ACGTGCATTGCA', CAST(p_partkey % 9 AS INTEGER) + 1, CAST(p_size % 3 AS INTEGER) + 1)"
_ALT = "substr('TGCAATGCCGTA', CAST(p_partkey % 8 AS INTEGER) + 1, CAST(p_size % 4 AS INTEGER) + 1)"


def _variants(t: Tables):
    ref = F.substr(F.lit("ACGTGCATTGCA"), (F.col("p_partkey") % 9 + 1).cast("int"), (F.col("p_size") % 3 + 1).cast("int"))
    alt = F.substr(F.lit("TGCAATGCCGTA"), (F.col("p_partkey") % 8 + 1).cast("int"), (F.col("p_size") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", ref.alias("ref"), alt.alias("alt"), F.concat_ws(":", F.lit("1"), F.col("p_partkey").cast("string"), ref, alt).alias("id"))


_V = f"SELECT p_partkey, {_BASES} AS ref, {_ALT} AS alt, '1:' || p_partkey || ':' || {_BASES} || ':' || {_ALT} AS id FROM part"


@query(f"SELECT p_partkey, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNV' WHEN length(ref) = length(alt) THEN 'MNV' WHEN length(ref) = 1 THEN 'SHORT_INS' WHEN length(alt) = 1 THEN 'SHORT_DEL' ELSE 'SHORT_INDEL' END AS variant_class, CAST(CASE WHEN length(ref) = length(alt) THEN length(ref) ELSE abs(length(alt) - length(ref)) END AS INTEGER) AS length FROM ({_V})")
def variant_class(t: Tables):
    return _variants(t).select("p_partkey", V.variant_class(F.col("ref"), F.col("alt")).alias("variant_class"), V.variant_length(F.col("ref"), F.col("alt")).alias("length"))


@query(f"SELECT p_partkey, split_part(id, ':', 1) AS chromosome, CAST(split_part(id, ':', 2) AS BIGINT) AS position, split_part(id, ':', 3) AS ref, split_part(id, ':', 4) AS alt FROM ({_V})")
def parse_positional_id(t: Tables):
    return _variants(t).select("p_partkey", V.positional_parts(F.replace("id", F.lit(":"), F.lit("-"))).alias("v")).select("p_partkey", "v.*")


@query(f"SELECT p_partkey, split_part(id, ':', 1) || ':' || split_part(id, ':', 2) || ':' || split_part(id, ':', 4) || ':' || split_part(id, ':', 3) AS swapped FROM ({_V})")
def swap_alleles(t: Tables):
    return _variants(t).select("p_partkey", V.swap_alleles(F.col("id")).alias("swapped"))


@query(f"SELECT p_partkey, reverse(translate(ref, 'ACGTacgt', 'TGCAtgca')) AS reversed FROM ({_V})")
def reverse_complement(t: Tables):
    return _variants(t).select("p_partkey", V.reverse_complement(F.col("ref")).alias("reversed"))


@query("SELECT p_partkey, CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN 'POSITIONAL' WHEN 1 THEN 'GNOMAD' WHEN 2 THEN 'REFSNP' WHEN 3 THEN 'SV' ELSE NULL END AS notation FROM part")
def nomenclature(t: Tables):
    k, n = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("1:"), n, F.lit(":A:G"))).when(k == 1, F.concat(F.lit("1-"), n, F.lit("-A-G"))).when(k == 2, F.concat(F.lit("rs"), n)).when(k == 3, "DEL_CHR1_ABCD1234").otherwise("no variant")
    return t.part.select("p_partkey", V.nomenclature(text).alias("notation"))


@query("SELECT page_id, regexp_matches(url, '^https?://[\\w.-]+(?:\\.[\\w\\.-]+)+(?:/[\\w\\-./?%&=]*)?$') AS is_url, regexp_matches(url, '^ENSG\\d+$') AS is_gene FROM pages")
def regex_classify(t: Tables):
    from strandloom.functions.patterns import PATTERNS

    return t.pages.select("page_id", F.rlike("url", F.lit(PATTERNS["url"])).alias("is_url"), F.rlike("url", F.lit(PATTERNS["ensembl_gene"])).alias("is_gene"))


@query("""
SELECT a.p_partkey, CASE WHEN len(list_distinct(string_split(lower(a.p_name), ' ') || string_split(lower(a.p_type), ' '))) = 0 THEN 0.0 ELSE
 CAST(len(list_intersect(list_distinct(string_split(lower(a.p_name), ' ')), list_distinct(string_split(lower(a.p_name || ' ' || a.p_type), ' ')))) AS DOUBLE) / len(list_distinct(string_split(lower(a.p_name || ' ' || a.p_type), ' '))) END AS similarity FROM part a""")
def jaccard(t: Tables):
    return t.part.select("p_partkey", S.jaccard_words(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type")).alias("similarity"))


@query("SELECT o_orderkey, 'custkey=' || o_custkey || ';priority=' || o_orderpriority || ';status=' || o_orderstatus AS info FROM orders")
def info_string(t: Tables):
    fields = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("custkey"), F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", S.info_string(fields).alias("info"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS custkey, 'true' AS flag, o_orderstatus || '=x' AS status FROM orders")
def info_parse(t: Tables):
    text = F.concat(F.lit("CK="), F.col("o_custkey").cast("string"), F.lit(";FLAG;ST="), F.col("o_orderstatus"), F.lit("=x"))
    m = t.orders.select("o_orderkey", S.parse_info(text).alias("m"))
    return m.select("o_orderkey", F.element_at("m", "CK").alias("custkey"), F.element_at("m", "FLAG").alias("flag"), F.element_at("m", "ST").alias("status"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 9) || '...' ELSE p_name END AS short FROM part")
def truncate(t: Tables):
    return t.part.select("p_partkey", S.truncate(F.col("p_name"), 12).alias("short"))


@query("SELECT s_suppkey, replace(lower(regexp_replace(s_name || ' AbcDef gHi', '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), ' ', '_') AS snake FROM supplier")
def snake_case(t: Tables):
    return t.supplier.select("s_suppkey", S.snake_case(F.concat("s_name", F.lit(" AbcDef gHi"))).alias("snake"))


@query("SELECT p_partkey, CAST(p_partkey % 3 AS INTEGER) = 0 AS balanced FROM part")
def is_balanced(t: Tables):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("("), "p_name", F.lit("(x))"))).when(k == 1, F.concat(F.lit("(("), "p_name", F.lit(")"))).otherwise(")a(")
    return t.part.select("p_partkey", S.is_balanced(text).alias("balanced"))


@query("SELECT p_partkey, CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey ELSE NULL END AS number FROM part")
def numeric_coercion(t: Tables):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    text = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".0"))).when(k == 2, F.concat(n, F.lit(".5"))).otherwise(F.concat(n, F.lit("x")))
    return t.part.select("p_partkey", S.to_number(text).alias("number"))


@query("SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS terms FROM part")
def alphabetize_terms(t: Tables):
    return t.part.select("p_partkey", S.alphabetize(F.col("p_name"), " ").alias("terms"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN '0' WHEN l_discount / 100 < 0.001 THEN printf('%.1e', l_discount / 100) ELSE 'rounded' END AS frequency FROM lineitem")
def freq_format(t: Tables):
    f = F.col("l_discount") / 100
    shown = S.frequency_format(f)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when((f == 0) | (f < 0.001), shown).otherwise("rounded").alias("frequency"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'A' ELSE l_returnflag END AS harmonised_allele, CASE WHEN l_returnflag = 'N' THEN -l_tax ELSE l_tax END AS harmonised_effect, CASE WHEN l_returnflag = 'N' THEN 1 - l_discount ELSE l_discount END AS non_ref_af FROM lineitem")
def gwas_harmonise(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("test_allele"), F.lit("N").alias("ref"), F.lit("A").alias("alt"), F.col("l_tax").alias("effect"), F.col("l_discount").alias("frequency"))
    return gwas.harmonise(rows).select("l_orderkey", "l_linenumber", "harmonised_allele", "harmonised_effect", "non_ref_af")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name WHEN p_size < 20 THEN p_type WHEN p_size < 30 THEN p_brand ELSE 'marker' END AS trait FROM part")
def trait_resolve(t: Tables):
    size = F.col("p_size")
    some = lambda cond, c: F.when(cond, F.array(c)).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", gwas.resolve_trait(F.when(size < 10, F.col("p_name")), some(size < 20, F.col("p_type")), some(size < 30, F.col("p_brand")), F.array(F.lit("marker"))).alias("trait"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'valid' WHEN p_size % 5 = 1 THEN 'valid' WHEN p_size % 5 = 2 THEN 'swapped' WHEN p_size % 5 = 3 THEN 'dropped' ELSE 'unverified' END AS status FROM part")
def allele_validation(t: Tables):
    k = F.col("p_size") % 5
    rs, genome, lifted = F.when(k == 0, "rs1"), F.when(k == 1, "A").when(k == 2, "G").otherwise("T"), k == 3
    return t.part.select("p_partkey", gwas.allele_status(rs, F.lit("A"), F.lit("G"), genome, lifted).alias("status"))


@query("SELECT p_partkey, list_sort(list_intersect(string_split(p_name, ' '), string_split(p_name || ' x', ' '))) = list_sort(list_distinct(string_split(p_name, ' '))) AS is_subset FROM part")
def set_ops_arrays(t: Tables):
    return t.part.select("p_partkey", S.is_subset(F.split("p_name", " "), F.split(F.concat("p_name", F.lit(" x")), " ")).alias("is_subset"))


@query(None)
def stable_ids(t: Tables):
    """Digests that Spark and the oracle lack: BLAKE2b and version-5 UUIDs."""
    return t.part.select("p_partkey", S.blake2b(F.col("p_name"), 4).alias("digest"), S.stable_uuid(F.col("p_name")).alias("uuid"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'NA' END AS flag, coalesce(p_size || ',' || p_partkey, 'NA') AS list, '{\"a\":' || p_size || '}' AS map, '2024-03-05' AS day FROM part WHERE p_size IS NOT NULL")
def as_text(t: Tables):
    rows = t.part.where("p_size IS NOT NULL")
    flag, items, fields, day = F.col("p_size") % 2 == 0, F.array(F.col("p_size").cast("long"), F.col("p_partkey").cast("long")), F.create_map(F.lit("a"), F.col("p_size")), F.to_date(F.lit("2024-03-05"))
    return rows.select("p_partkey", S.as_text(flag, "boolean", false_is_null=True).alias("flag"), S.as_text(items, "array<bigint>").alias("list"), S.as_text(fields, "map<string,int>").alias("map"), S.as_text(day, "date").alias("day"))


@query("SELECT o_orderkey, format('{:,}', o_orderkey * 1001) AS commas, printf('%.2f', o_totalprice) AS plain, printf('%.2e', o_totalprice) AS sci FROM orders WHERE o_totalprice > 0")
def number_formats(t: Tables):
    return t.orders.where("o_totalprice > 0").select("o_orderkey", S.thousands(F.col("o_orderkey") * 1001).alias("commas"), S.fixed(F.col("o_totalprice")).alias("plain"), S.sci_notation(F.col("o_totalprice")).alias("sci"))


@query("""
SELECT p_partkey, array_to_string(w, '|') AS joined, len(list_filter(w, lambda x: contains(x, 'e'))) AS n_found, len(list_filter(w, lambda x: contains(lower(x), 'e'))) AS n_found_any_case,
  list_position(w, w[1]) AS first_place, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: contains(p_type, x))) > 0 AS in_type
FROM (SELECT *, string_split(p_name, ' ') AS w FROM part WHERE p_name IS NOT NULL)""")
def list_helpers(t: Tables):
    w = F.split("p_name", " ")
    numbered = S.numbered_items(F.array_distinct(w))
    return t.part.where("p_name IS NOT NULL").select("p_partkey", S.joined(w, "|").alias("joined"), F.size(S.found_in(w, F.lit("e"))).alias("n_found"), F.size(S.found_in(w, F.lit("E"), True)).alias("n_found_any_case"), F.element_at(numbered, F.get(w, F.lit(0))).alias("first_place"), F.size(F.split(S.joined(w, " ", distinct=True), " ")).alias("n_distinct"), S.any_in_text(w, F.col("p_type")).alias("in_type"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a=' || c_custkey ELSE 'a=' || c_custkey || ';b=x' END AS info, c_custkey % 4 = 0 AS nothing FROM customer")
def pruned_map(t: Tables):
    k = F.col("c_custkey")
    fields = F.create_map(F.lit("a"), k.cast("string"), F.lit("b"), F.when(k % 3 == 0, "").otherwise("x"), F.lit("c"), F.lit(None).cast("string"), F.lit("d"), F.lit("dropped"))
    return t.customer.select("c_custkey", S.info_string(S.pruned(fields, ["d"])).alias("info"), S.none_left(F.array(F.when(k % 4 > 0, k))).alias("nothing"))


@query("SELECT c_custkey, 'PMID:' || (10000000 + c_custkey) AS pubmed, 'EFO_' || c_custkey AS trait FROM customer")
def citation_ids(t: Tables):
    n = F.col("c_custkey")
    url = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), (n + 10000000).cast("string"), F.when(n % 2 == 0, "/").otherwise(""))
    return t.customer.select("c_custkey", S.pubmed_curie(url).alias("pubmed"), S.term_id(F.concat(F.lit("http://www.ebi.ac.uk/efo/EFO_"), n.cast("string"))).alias("trait"))


@query("""
SELECT c_custkey, text, text IN ('1.5', '-3', 'nan') AS is_number, text = '-3' AS is_integer, text IN ('1.5', 'nan') AS is_float, CASE WHEN text IN ('2024-03-05', '03/05/2024', '20240305', '5 Mar 2024') THEN DATE '2024-03-05' END AS day
FROM (SELECT c_custkey, ['1.5', '-3', 'nan', 'x', '2024-03-05', '03/05/2024', '5 Mar 2024'][CAST(c_custkey % 7 AS INTEGER) + 1] AS text FROM customer)""")
def typed_texts(t: Tables):
    texts = F.array(*map(F.lit, ("1.5", "-3", "nan", "x", "2024-03-05", "03/05/2024", "5 Mar 2024")))
    text = F.get(texts, (F.col("c_custkey") % 7).cast("int"))
    return t.customer.select("c_custkey", text.alias("text"), S.is_number(text).alias("is_number"), S.is_integer(text).alias("is_integer"), S.is_float(text).alias("is_float"), S.to_day(text).alias("day"))
