"""Consequences and frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import annotation as A
from strandloom.plans.registry import Tables, query

_TERMS = ["stop_gained", "missense_variant", "intron_variant", "NMD_transcript_variant", "upstream_gene_variant", "intergenic_variant", "splice_region_variant"]


def _combos(t: Tables):
    term = lambda k: F.element_at(F.array(*map(F.lit, _TERMS)), (k % len(_TERMS) + 1).cast("int"))
    return t.part.select("p_partkey", F.array_distinct(F.array(term(F.col("p_partkey")), term(F.col("p_size")))).alias("terms"))


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _places(words) -> str:
    return ", ".join(f"('{t}', {k})" for t, k in words.items())


_HIGH = {t: k + 1 for k, t in enumerate(A.HIGH_IMPACT)}
_MODIFIER = {t: k + 1 for k, t in enumerate(A.MODIFIER)}
_ALL = {t: k + 1 for k, t in enumerate([*A.HIGH_IMPACT, *A.NMD, *A.MODIFIER])}
_PART_TERMS = f"SELECT p_partkey, list_distinct([{_listed(_TERMS)}[p_partkey % 7 + 1], {_listed(_TERMS)}[p_size % 7 + 1]]) AS terms FROM part"
#: Groups, letters of the terms' places, and the order of all combinations.
_RANKS = f"""
p AS ({_PART_TERMS}),
k AS (SELECT DISTINCT array_to_string(list_sort(terms), ',') AS key FROM p UNION SELECT unnest({_listed(_ALL)})),
w AS (SELECT key, string_split(key, ',') AS terms FROM k),
h(t, n) AS (VALUES {_places(_HIGH)}), m(t, n) AS (VALUES {_places(_MODIFIER)}), c(t, n) AS (VALUES {_places(_ALL)}),
g AS (
  SELECT key, 0 AS grp, terms FROM w WHERE list_has_any(terms, {_listed(A.HIGH_IMPACT)}) AND NOT list_has_any(terms, {_listed([*A.NMD, *A.NON_CODING])})
  UNION ALL SELECT key, 1, terms FROM w WHERE list_has_any(terms, {_listed(A.NMD)})
  UNION ALL SELECT key, 2, terms FROM w WHERE list_has_any(terms, {_listed(A.NON_CODING)})
  UNION ALL SELECT key, 3, terms FROM w WHERE list_has_all({_listed(_MODIFIER)}, terms)),
l AS (
  SELECT key, grp, coalesce(string_agg(chr(CAST(64 + n AS INTEGER)), '' ORDER BY n), '') AS letters FROM (
    SELECT g.key, g.grp, coalesce(CASE WHEN grp = 0 THEN h.n WHEN grp = 3 THEN m.n ELSE c.n END) AS n
    FROM (SELECT key, grp, unnest(terms) AS t FROM g) g LEFT JOIN h ON h.t = g.t LEFT JOIN m ON m.t = g.t LEFT JOIN c ON c.t = g.t) GROUP BY 1, 2),
o AS (SELECT key, max(place) AS place FROM (SELECT key, row_number() OVER (ORDER BY grp, letters[1:1], length(letters) DESC, letters, key) AS place FROM l) GROUP BY 1),
r AS (SELECT key, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS rank FROM o)"""


@query(f"WITH {_RANKS} SELECT p_partkey, key AS combo, rank FROM (SELECT *, array_to_string(list_sort(terms), ',') AS key FROM p) JOIN r USING (key)")
def consequence_rank(t: Tables):
    """Ranks of all combinations; held against a plain implementation in the tests too."""
    ranks = A.rank_combos(A.default_combos(t.spark, _combos(t)))
    return A.rank_consequences(_combos(t), ranks).select("p_partkey", A.combo_key(F.col("terms")).alias("combo"), "rank")


@query(f"WITH {_RANKS} SELECT p_partkey, key AS combo, rank FROM (SELECT *, array_to_string(list_sort(terms), ',') AS key FROM p) JOIN r USING (key)")
def consequence_rerank(t: Tables):
    """From a table of single terms: the combinations are added and all are ranked anew."""
    ranks = A.rank_combos(A.default_combos(t.spark))
    return A.rank_consequences(_combos(t), ranks).select("p_partkey", A.combo_key(F.col("terms")).alias("combo"), "rank")


_KIND_SQL = "CASE n % 4 WHEN 0 THEN 'transcript' WHEN 1 THEN 'regulatory_feature' WHEN 2 THEN 'motif_feature' ELSE 'intergenic' END"


@query(f"""
WITH {_RANKS}, x AS (
  SELECT l_orderkey, CASE l_suppkey % 2 WHEN 0 THEN 'A' ELSE 'T' END AS allele, {_KIND_SQL.replace("n %", "l_partkey %")} AS kind, l_linenumber AS vep_order, r.rank
  FROM lineitem JOIN (SELECT *, array_to_string(list_sort(terms), ',') AS key FROM p) q ON q.p_partkey = l_partkey JOIN r USING (key))
SELECT l_orderkey, allele, {", ".join(f"coalesce(string_agg(rank || '/' || vep_order, ',' ORDER BY rank, vep_order) FILTER (WHERE kind = '{k}'), '') AS {k}" for k in A.KINDS)} FROM x GROUP BY 1, 2""")
def ranked_document(t: Tables):
    kind = F.element_at(F.array(*map(F.lit, A.KINDS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = t.lineitem.join(_combos(t), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select("l_orderkey", F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("T").alias("allele"), kind.alias("kind"), F.col("l_linenumber").alias("vep_order"), "terms")
    found = A.ranked_document(rows, A.rank_combos(A.default_combos(t.spark)), ["l_orderkey"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("/", x["rank"].cast("string"), x["vep_order"].cast("string"))), ",")
    return found.select("l_orderkey", "allele", *(text(F.col(k)).alias(k) for k in A.KINDS))


@query(f"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS impact, CASE p_size % 3 WHEN 0 THEN '#ff00ff' WHEN 1 THEN '#377eb8' END AS colour, p_partkey % 7 IN (0, 1) OR p_size % 7 IN (0, 1) AS is_coding, CASE WHEN p_size % 2 = 0 THEN 'S' || p_partkey END AS gene_symbol FROM part")
def consequence_summary(t: Tables):
    k = F.col("p_partkey").cast("string")
    impact = F.when(F.col("p_size") % 3 == 0, "high").when(F.col("p_size") % 3 == 1, "LOW").otherwise("none")
    gene = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ENSG"), k))
    rows = t.part.select("p_partkey", "p_size").join(_combos(t), "p_partkey")
    s = rows.select("p_partkey", A.consequence_summary(F.col("terms"), impact, gene, F.concat(F.lit("S"), k)).alias("s"))
    return s.select("p_partkey", "s.impact", "s.colour", "s.is_coding", "s.impacted_gene.gene_symbol")


@query("SELECT p_partkey, CAST(p_partkey % 7 AS INTEGER) IN (0, 1) OR p_size % 7 IN (0, 1) AS coding FROM part")
def is_coding(t: Tables):
    return _combos(t).select("p_partkey", A.is_coding(F.col("terms")).alias("coding"))


@query("SELECT l_orderkey, kind, l_linenumber AS vep_order FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k, l_suppkey % 5, l_linenumber) AS n FROM (SELECT *, CAST(l_partkey % 4 AS INTEGER) AS k, CASE CAST(l_partkey % 4 AS INTEGER) WHEN 0 THEN 'transcript' WHEN 1 THEN 'regulatory_feature' WHEN 2 THEN 'motif_feature' ELSE 'intergenic' END AS kind FROM lineitem)) WHERE n = 1")
def most_severe(t: Tables):
    kind = F.element_at(F.array(*map(F.lit, A.KINDS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = t.lineitem.select("l_orderkey", kind.alias("kind"), (F.col("l_suppkey") % 5).alias("rank"), F.col("l_linenumber").alias("vep_order"))
    return A.most_severe(rows, ["l_orderkey"]).select("l_orderkey", "kind", "vep_order")


def _freqs():
    return F.create_map(F.lit("gnomad_afr"), F.col("p_size") / 100, F.lit("aa"), F.col("p_size") / 200, F.lit("EUR"), F.col("p_size") / 400)


@query("SELECT p_partkey, p_size / 100 AS gnomad, p_size / 200 AS esp, p_size / 400 AS kg FROM part")
def group_frequencies(t: Tables):
    split = t.part.select("p_partkey", A.split_frequencies(_freqs()).alias("f"))
    return split.select("p_partkey", F.element_at("f.GnomAD", "gnomad_afr").alias("gnomad"), F.element_at("f.ESP", "aa").alias("esp"), F.element_at(F.col("f")["1000Genomes"], "EUR").alias("kg"))


@query("SELECT p_partkey, datasource, population, frequency FROM (SELECT p_partkey, 'GnomAD' AS datasource, 'gnomad_afr' AS population, p_size / 100 AS frequency FROM part UNION ALL SELECT p_partkey, 'ESP', 'aa', p_size / 200 FROM part UNION ALL SELECT p_partkey, '1000Genomes', 'EUR', p_size / 400 FROM part)")
def frequency_table(t: Tables):
    f = A.split_frequencies(_freqs())
    nested = F.create_map(F.lit("GnomAD"), f["GnomAD"], F.lit("ESP"), f["ESP"], F.lit("1000Genomes"), f["1000Genomes"])
    return A.frequency_rows(t.part.select("p_partkey", nested.alias("allele_frequencies")))


@query("SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS BIGINT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_each_explode(t: Tables):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,long>")).alias("key", "value"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) / 64 AS gnomad, p_size % 2 = 0 AS has_kg FROM part")
def allele_freq_parse(t: Tables):
    text = F.concat(F.lit("GnomAD:0.5,"), (F.col("p_size") / 64).cast("string"), F.lit("|1000Genomes:0.9,"), F.when(F.col("p_size") % 2 == 0, "0.1").otherwise("."))
    m = t.part.select("p_partkey", A.allele_frequencies(text, F.lit(1)).alias("m"))
    return m.select("p_partkey", F.try_element_at("m", F.lit("GnomAD")).alias("gnomad"), F.map_contains_key("m", F.lit("1000Genomes")).alias("has_kg"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN 0.3 WHEN p_size % 3 = 1 THEN 0.2 ELSE 0.1 END AS DOUBLE) AS frequency FROM part")
def colocated_pick(t: Tables):
    v = lambda name, f: F.struct(F.lit(name).alias("id"), F.lit(f).alias("frequencies"))
    k = F.col("p_size") % 3
    lists = F.when(k == 0, F.array(v("COSV1", 0.3))).when(k == 1, F.array(v("rs1", 0.1), v("rs2", 0.2), v("COSV2", 0.9))).otherwise(F.array(v("rs1", 0.1), v("COSV2", 0.9)))
    return t.part.select("p_partkey", A.colocated_frequencies(lists).alias("frequency"))


@query("SELECT p_partkey, datasource, population, CASE population WHEN 'aa' THEN 'African American' ELSE population END AS display_name, frequency FROM (SELECT p_partkey, 'GnomAD' AS datasource, 'gnomad_afr' AS population, p_size / 100 AS frequency FROM part UNION ALL SELECT p_partkey, 'ESP', 'aa', p_size / 200 FROM part UNION ALL SELECT p_partkey, '1000Genomes', 'EUR', p_size / 400 FROM part)")
def frequency_populations(t: Tables):
    names = t.spark.createDataFrame([("ESP", "aa", "African American"), ("GnomAD", "aa", "other")], "datasource string, source_id string, display_name string")
    return A.with_populations(frequency_table(t), names)
