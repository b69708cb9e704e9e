"""File formats: lines made from the tables are written, read by the reader of their format, and must come back as the tables say."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.plans.registry import Tables, query
from strandloom.sources import blocks as B
from strandloom.sources import genomic as G
from strandloom.sources import tables as S
from strandloom.staging import new_place, text_files

TAB = "\t"


def _text(*parts):
    """Columns and words one after another."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _xml(lines, name: str) -> str:
    """A file with the elements of a few lines (those of nation) in one root."""
    whole = lines.toDF("line").agg(F.concat(F.lit("<all>"), F.concat_ws("", F.collect_list("line")), F.lit("</all>")))
    return text_files(whole, name)


def _vcf(t: Tables):
    """Parts as variants: two alternatives for even sizes, an id for three in four."""
    k, s = F.col("p_partkey"), F.col("p_size")
    chrom, snp = k % 3 + 1, F.when(k % 4 > 0, _text("rs", k)).otherwise(".")
    info = F.when(s % 2 == 0, _text("N=", s, ";DB;FREQ=KG:0.5,0.25,.|GnomAD:0.5,.,0.125")).otherwise(_text("N=", s))
    line = F.concat_ws(TAB, chrom.cast("string"), (k * 10).cast("string"), snp, F.lit("A"), F.when(s % 2 == 0, "C,G").otherwise("T"), F.lit("."), F.lit("PASS"), info, F.lit("."))
    return G.read_vcf(t.spark, text_files(t.part.where("p_size IS NOT NULL").select(line), "vcf"))


_VCF = "SELECT p_partkey, p_size, p_partkey % 3 + 1 AS c, CAST(p_partkey AS BIGINT) * 10 AS pos, CASE WHEN p_partkey % 4 > 0 THEN 'rs' || p_partkey END AS id, unnest(CASE WHEN p_size % 2 = 0 THEN ['C', 'G'] ELSE ['T'] END) AS alt, generate_subscripts(CASE WHEN p_size % 2 = 0 THEN ['C', 'G'] ELSE ['T'] END, 1) - 1 AS alt_index FROM part WHERE p_size IS NOT NULL"


@query(f"SELECT CAST(c AS VARCHAR) AS chrom, pos, id, CAST(alt_index AS INTEGER) AS alt_index, alt, CAST(p_size AS VARCHAR) AS n, p_size % 2 = 0 AS db FROM ({_VCF})")
def vcf_rows(t: Tables):
    rows = G.per_alt(_vcf(t))
    return rows.select("chrom", "pos", "id", "alt_index", "alt", F.try_element_at("info", F.lit("N")).alias("n"), F.map_contains_key("info", F.lit("DB")).alias("db"))


@query("SELECT p_partkey * 10 AS pos, 'A' AS ref FROM part WHERE p_partkey % 3 = 1 AND p_partkey BETWEEN 10 AND 300 AND p_size IS NOT NULL")
def vcf_region(t: Tables):
    return G.search_vcf(_vcf(t), "chr2", 100, 3000).select("pos", "ref")


@query("SELECT 'chr' || (n_nationkey % 4 + 1) AS chromosome, CAST(n_nationkey AS BIGINT) * 700 AS start, CAST(n_nationkey AS BIGINT) * 700 + 5000 AS \"end\", count(p_partkey) AS n FROM nation LEFT JOIN part ON p_partkey % 3 = n_nationkey % 4 AND p_partkey * 10 BETWEEN n_nationkey * 700 AND n_nationkey * 700 + 5000 AND p_size IS NOT NULL GROUP BY ALL")
def vcf_region_counts(t: Tables):
    k = F.col("n_nationkey")
    regions = t.nation.select(_text("chr", k % 4 + 1).alias("chromosome"), (k.cast("long") * 700).alias("start"), (k.cast("long") * 700 + 5000).alias("end"))
    return G.count_vcf(_vcf(t), regions)


@query(f"SELECT pos, alt, CAST(CASE WHEN alt = 'C' THEN 0.25 END AS DOUBLE) AS kg, CAST(CASE WHEN alt = 'G' THEN 0.125 END AS DOUBLE) AS gnomad FROM ({_VCF})")
def vcf_frequencies(t: Tables):
    rows = G.dbsnp_frequencies(G.per_alt(_vcf(t)))
    of = lambda name: F.try_element_at("allele_frequencies", F.lit(name))
    return rows.select("pos", "alt", of("KG").alias("kg"), of("GnomAD").alias("gnomad"))


def _vcf_text(t: Tables) -> str:
    """The path of whole VCF lines, some with samples, without an order, and a header."""
    k, s = F.col("p_partkey"), F.col("p_size")
    line = F.concat_ws(TAB, (k % 3 + 1).cast("string"), (k * 10).cast("string"), _text("rs", k), F.repeat(F.lit("A"), (s % 5 + 1).cast("int")), F.lit("T"), (s * 2).cast("string"), F.lit("q10"), _text("AF=0.", s, ";DB;N=", k), F.when(s % 2 == 0, _text("GT", TAB, "0/1")).otherwise("GT"))
    header = t.spark.createDataFrame([("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT",)], "line string")
    return text_files(header.unionByName(t.part.where("p_size IS NOT NULL").select(line.alias("line"))), "vcf-lines")


_LINE = "concat_ws(chr(9), {c}, p_partkey * 10, 'rs' || p_partkey, repeat('A', CAST(p_size % 5 + 1 AS BIGINT)), 'T', p_size * 2, 'q10', 'AF=0.' || p_size || ';DB;N=' || p_partkey, CASE WHEN p_size % 2 = 0 THEN 'GT' || chr(9) || '0/1' ELSE 'GT' END)"


@query(f"SELECT CAST(p_partkey % 3 + 1 AS VARCHAR) AS chromosome, p_partkey * 10 AS position, {_LINE.format(c='p_partkey % 3 + 1')} AS line FROM part WHERE p_size IS NOT NULL")
def vcf_split(t: Tables):
    """Lines split by chromosome into indexed files, read again: every line as it was."""
    where = new_place(t.spark, "vcf-split")
    B.split_by_chromosome(t.spark, _vcf_text(t), where)
    return B.read_blocks(t.spark, where).select("chromosome", "position", "line")


@query(f"SELECT CASE p_partkey % 3 WHEN 0 THEN '1' ELSE '2' END AS chromosome, count(*) AS n, min(p_partkey * 10) AS first_pos, max({_LINE.format(c=chr(39) + 'chr' + chr(39) + ' || CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 2 END')}) AS last_line FROM part WHERE p_partkey % 3 < 2 AND p_size IS NOT NULL GROUP BY 1")
def vcf_rename(t: Tables):
    """Contigs renamed (one has no new name) on the way to indexed files."""
    names = t.spark.createDataFrame([("1", "chr1"), ("2", "chr2")], "old string, new string")
    where = new_place(t.spark, "vcf-rename")
    B.split_by_chromosome(t.spark, _vcf_text(t), where, names)
    return B.read_blocks(t.spark, where).groupBy("chromosome").agg(F.count("*").alias("n"), F.min("position").alias("first_pos"), F.max("line").alias("last_line"))


@query("SELECT p_partkey * 10 AS position, p_partkey * 10 + p_size % 5 AS stop FROM part WHERE p_size IS NOT NULL AND p_partkey % 3 = 1 AND p_partkey * 10 <= 3000 AND p_partkey * 10 + p_size % 5 >= 103")
def vcf_indexed_region(t: Tables):
    """A region of indexed files: only its blocks are read."""
    where = new_place(t.spark, "vcf-region")
    header, lines = B.vcf_lines(t.spark, _vcf_text(t))
    B.write_blocks(lines, header, where)
    return B.read_region(t.spark, where, "chr2", 103, 3000).select("position", "stop")


@query("SELECT CAST(p_partkey % 3 + 1 AS VARCHAR) AS CHROM, CAST(p_partkey * 10 AS VARCHAR) AS POS, CAST(p_size * 2 AS VARCHAR) AS QUAL, '0.' || p_size AS AF, '1' AS DB, '.' AS none FROM part WHERE p_size IS NOT NULL")
def vcf_fields(t: Tables):
    fields = B.extract_fields(B.vcf_lines(t.spark, _vcf_text(t))[1], ["CHROM", "POS", "QUAL", "INFO/AF", "INFO/DB", "INFO/XX"])
    return fields.withColumnsRenamed({"INFO/AF": "AF", "INFO/DB": "DB", "INFO/XX": "none"})


@query("SELECT 'ENSG' || c_custkey AS gene_id, 'S' || c_custkey AS symbol, 'chr' || (c_custkey % 22 + 1) AS chromosome, CASE WHEN c_custkey % 5 = 0 THEN 'ncRNA_gene' ELSE 'protein_coding' END AS gene_type, CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1 END AS INTEGER) AS n_transcripts, CASE WHEN c_custkey % 3 > 0 THEN 'ENSP' || c_custkey END AS protein FROM customer WHERE c_custkey % 7 <> 6")
def gff_genes(t: Tables):
    first = F.get(F.get("transcripts", F.lit(0))["proteins"], F.lit(0))
    return _models(t).select("gene_id", "symbol", "chromosome", "gene_type", F.when(F.col("transcripts").isNotNull(), F.size("transcripts")).alias("n_transcripts"), first.alias("protein"))


def _models(t: Tables):
    k = F.col("c_custkey")
    row = lambda kind, attributes: F.concat_ws(TAB, F.when(k % 7 == 6, "KI27").otherwise((k % 22 + 1).cast("string")), F.lit("e"), F.lit(kind), k.cast("string"), (k + 90).cast("string"), F.lit("."), F.lit("."), F.lit("."), attributes)
    gene = row("gene", _text("ID=gene:ENSG", k, ";Name=S", k, ";biotype=", F.when(k % 5 == 0, "misc_RNA").otherwise("protein_coding")))
    parts = [row("mRNA", _text("ID=transcript:ENST", k, ";Parent=gene:ENSG", k)), row("exon", _text("Parent=transcript:ENST", k, ";exon_id=ENSE", k)), row("CDS", _text("ID=CDS:ENSP", k, ";Parent=transcript:ENST", k, ";protein_id=ENSP", k))]
    lines = t.customer.select(F.explode(F.when(k % 3 == 0, F.array(gene)).otherwise(F.array(gene, *parts))))
    return G.gene_models(G.read_gff3(t.spark, text_files(lines, "gff")))


@query("SELECT 'chr' || (c_custkey % 22 + 1) AS chromosome, 'ENSG' || c_custkey AS gene FROM customer WHERE c_custkey % 7 <> 6")
def gene_documents(t: Tables):
    """A JSON document for each gene, written by chromosome and read again."""
    where = new_place(t.spark, "genes")
    G.gene_documents(_models(t)).write.partitionBy("chromosome").text(where)
    return t.spark.read.text(where).select("chromosome", F.get_json_object("value", "$.gene_id").alias("gene"))


@query("SELECT 'P' || l_suppkey AS db_object_id, 'GO:' || l_partkey % 50 AS go_id, array_to_string(list_sort(list_distinct(list(CASE l_linenumber % 2 WHEN 0 THEN 'IEA' ELSE 'IDA' END || ';enables;PMID:1'))), '|') AS evidence FROM lineitem GROUP BY 1, 2")
def gaf_evidence(t: Tables):
    line = F.concat_ws(TAB, F.lit("U"), _text("P", F.col("l_suppkey")), F.lit("S"), F.lit("enables"), _text("GO:", F.col("l_partkey") % 50), F.lit("PMID:1"), F.when(F.col("l_linenumber") % 2 == 0, "IEA").otherwise("IDA"), F.lit("a|b"), *[F.lit("")] * 9)
    found = G.evidence_sets(G.read_gaf(t.spark, text_files(t.lineitem.select(line), "gaf")))
    return found.select("db_object_id", "go_id", F.array_join("evidence", "|").alias("evidence"))


@query("SELECT DISTINCT 'P' || o_custkey AS uniprot_id, CASE o_orderkey % 3 WHEN 0 THEN 'Ensembl' ELSE 'Ensembl_PRO' END AS id_type, CASE o_orderkey % 3 WHEN 0 THEN 'ENSG' ELSE 'ENSP' END || o_custkey AS mapped_id FROM orders WHERE o_orderkey % 3 < 2")
def id_mapping(t: Tables):
    k, m = F.col("o_custkey"), F.col("o_orderkey") % 3
    kind = F.when(m == 0, "Ensembl").when(m == 1, "Ensembl_PRO").otherwise("GeneID")
    line = F.concat_ws(TAB, _text("P", k), kind, _text(F.when(m == 0, "ENSG").otherwise("ENSP"), k, ".", F.col("o_orderkey") % 5))
    return G.read_id_mapping(t.spark, text_files(t.orders.select(line), "idmap"))


@query("SELECT 'path:' || r_regionkey AS pathway_id, 'way ' || r_regionkey AS pathway_name, 'hsa:' || n_nationkey AS gene FROM region JOIN nation ON n_regionkey = r_regionkey")
def kegg_pathways(t: Tables):
    entry = F.concat_ws("", F.collect_list(_text('<entry id="', F.col("n_nationkey"), '" type="gene" name="hsa:', F.col("n_nationkey"), '"></entry>')))
    lines = t.nation.groupBy("n_regionkey").agg(entry.alias("e")).select(_text('<pathway name="path:', F.col("n_regionkey"), '" title="way ', F.col("n_regionkey"), '">', F.col("e"), '<entry id="999" type="map" name="path:x"></entry></pathway>'))
    return G.read_kgml(t.spark, _xml(lines, "kgml"))


@query("SELECT 'R-' || (c_nationkey % 10) AS pathway_id, 'way ' || (c_nationkey % 10) AS pathway_name, array_to_string(list_sort(list_distinct(list('ENSG' || c_custkey))), ',') AS genes FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 5 <> 4 GROUP BY 1, 2")
def reactome_pathways(t: Tables):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 10
    line = F.concat_ws(TAB, F.when(k % 5 == 4, _text("XP", k)).otherwise(_text("ENSG", k)), _text("R-", n), F.lit("http://x"), _text("way ", n), F.lit("TAS"), F.when(k % 4 == 3, "Mus musculus").otherwise("Homo sapiens"))
    return G.read_reactome(t.spark, text_files(t.customer.select(line), "reactome")).select("pathway_id", "pathway_name", F.array_join("genes", ",").alias("genes"))


@query("SELECT 'rs' || c_custkey AS ref_snp_id, 'rs' || least(c_custkey + 8 - c_custkey % 8, (SELECT max(c_custkey) + 1 FROM customer)) AS merged_into FROM customer WHERE c_custkey % 8 <> 0")
def snp_merges(t: Tables):
    """Chains of up to seven merges, resolved to their ends."""
    k = F.col("c_custkey")
    line = _text('{"refsnp_id":"', k, '","dbsnp1_merges":[],"merged_snapshot_data":{"merged_into":[', F.when(k % 8 != 0, _text('"', k + 1, '"')).otherwise(""), "]}}")
    return G.resolve_merges(G.read_merges(t.spark, text_files(t.customer.select(line), "merges")))


@query("SELECT 'S' AS \"schema\", 'T' || n_regionkey AS \"table\", n_name AS name, CAST(n_nationkey AS VARCHAR) AS key FROM nation")
def xml_records(t: Tables):
    record = F.concat_ws("", F.collect_list(_text('<Record><Field name="key">', F.col("n_nationkey"), '</Field><Field name="name"> ', F.col("n_name"), " </Field></Record>")))
    lines = t.nation.groupBy("n_regionkey").agg(record.alias("r")).select(_text('<Table schema="S" name="T', F.col("n_regionkey"), '">', F.col("r"), "</Table>"))
    rows = G.read_xml_records(t.spark, _xml(lines, "xml"))
    return rows.select("schema", "table", F.element_at("fields", "name").alias("name"), F.element_at("fields", "key").alias("key"))


def _owl(t: Tables) -> str:
    k = F.col("n_nationkey")
    label = F.when(k % 3 > 0, _text("<rdfs:label>", F.col("n_name"), "</rdfs:label>")).otherwise("")
    words = F.when(k % 2 == 0, _text("<obo:IAO_0000115>about ", k, "</obo:IAO_0000115>")).otherwise("")
    synonyms = F.when(k % 5 > 0, _text("<oboInOwl:hasExactSynonym>b", k, "</oboInOwl:hasExactSynonym><oboInOwl:hasExactSynonym>a", k, "</oboInOwl:hasExactSynonym>")).otherwise("")
    line = _text('<owl:Class rdf:about="http://x.org/obo/XX_', k, '"><rdfs:subClassOf rdf:resource="http://x.org/obo/XX_R', F.col("n_regionkey"), '"/>', label, words, synonyms, "</owl:Class>")
    return _xml(t.nation.select(line), "owl")


@query("SELECT 'XX:' || n_nationkey AS curie, CASE WHEN n_nationkey % 3 > 0 THEN n_name ELSE 'XX:' || n_nationkey END AS term, CASE WHEN n_nationkey % 2 = 0 THEN 'about ' || n_nationkey END AS definition, CASE WHEN n_nationkey % 5 > 0 THEN 'a' || n_nationkey || ',b' || n_nationkey END AS synonyms FROM nation")
def owl_terms(t: Tables):
    return G.read_owl(t.spark, _owl(t)).select("curie", "term", "definition", F.array_join("synonyms", ",").alias("synonyms"))


@query("""
SELECT 'XX:' || n_nationkey AS subject, p AS predicate, o AS object FROM (
  SELECT n_nationkey, 'subClassOf' AS p, 'XX:R' || n_regionkey AS o FROM nation UNION ALL SELECT n_nationkey, 'label', n_name FROM nation WHERE n_nationkey % 3 > 0
  UNION ALL SELECT n_nationkey, 'definition', 'about ' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, 'synonym', unnest(['a' || n_nationkey, 'b' || n_nationkey]) FROM nation WHERE n_nationkey % 5 > 0)""")
def owl_triples(t: Tables):
    return G.read_owl_triples(t.spark, _owl(t))


@query("SELECT 'XX:' || n_nationkey AS curie, CASE WHEN n_nationkey % 3 > 0 THEN n_name WHEN n_nationkey % 5 > 0 THEN 'a' || n_nationkey ELSE 'XX:' || n_nationkey END AS term, CASE WHEN n_nationkey % 2 = 0 THEN 'about ' || n_nationkey WHEN n_nationkey % 3 > 0 THEN n_name END AS definition FROM nation")
def term_fallbacks(t: Tables):
    return G.term_fallbacks(G.read_owl_triples(t.spark, _owl(t)))


@query("SELECT 'ENSG' || n_nationkey AS gene, n_name AS symbol FROM nation WHERE n_nationkey % 4 > 0")
def hgnc_documents(t: Tables):
    doc = _text('{"symbol":"', F.col("n_name"), '"', F.when(F.col("n_nationkey") % 4 > 0, _text(',"ensembl_gene_id":"ENSG', F.col("n_nationkey"), '"')).otherwise(""), "}")
    lines = t.nation.agg(F.concat(F.lit('{"response":{"docs":['), F.array_join(F.collect_list(doc), ","), F.lit("]}}")))
    return G.read_hgnc(t.spark, text_files(lines, "hgnc")).select(F.col("ensembl_gene_id").alias("gene"), "symbol")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def delimited_file(t: Tables):
    """Found by its first lines: the delimiter is a semicolon; blanks around values go."""
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")), F.col("c_nationkey").cast("string"))
    return S.read_delimited(t.spark, text_files(t.customer.select(line), "delimited"), header=False, names=["c_custkey", "c_name", "c_nationkey"])


@query("SELECT CASE n_nationkey WHEN 24 THEN 'chrM' ELSE 'chr' || n_nationkey END AS chromosome, CAST(n_nationkey AS BIGINT) * 1000 AS length FROM nation")
def chromosome_map(t: Tables):
    k = F.col("n_nationkey")
    line = F.concat_ws(TAB, F.when(k == 24, "MT").when(k % 2 == 0, _text("chr", k)).otherwise(k.cast("string")), (k * 1000).cast("string"))
    return S.read_chromosome_map(t.spark, text_files(t.nation.select(line), "chromosomes"))


@query("SELECT 'hg38' AS build, count(*) AS n FROM nation")
def json_config(t: Tables):
    lines = t.nation.agg(F.count("*").alias("n")).select(F.explode(F.array(F.lit('{"build": "hg38",'), _text(' "n": ', F.col("n"), "}"))))
    return S.read_json_record(t.spark, text_files(lines.coalesce(1), "config")).select("build", "n")


@query("""SELECT n_name || ' a-b/c' AS subject, 'in' AS predicate, r_name AS object, 'iri' AS object_kind FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT n_name || ' a-b/c', 'says', 'a "' || n_name || '" \\n ' || chr(10) || chr(9) || ' end', 'literal' FROM nation""")
def triples_file(t: Tables):
    """N-Triples with names that need encoding and literals that need escapes, written and read again."""
    rows = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    name = F.concat("n_name", F.lit(" a-b/c"))
    said = F.concat(F.lit('a "'), "n_name", F.lit('" \\n \n\t end'))
    triples = rows.select(name.alias("subject"), F.lit("in").alias("predicate"), F.col("r_name").alias("object"), F.lit("iri").alias("object_kind"))
    triples = triples.unionByName(rows.select(name.alias("subject"), F.lit("says").alias("predicate"), said.alias("object"), F.lit("literal").alias("object_kind")))
    where = new_place(t.spark, "triples")
    S.write_triples(triples, where)
    return S.read_ntriples(t.spark, where)


@query("SELECT 'full' AS file, count(*) AS n, 4 AS columns FROM orders UNION ALL SELECT 'brief', count(*), 2 FROM orders")
def association_files(t: Tables):
    """All statistics and the p-values alone, written and counted."""
    full, brief = new_place(t.spark, "full"), new_place(t.spark, "brief")
    S.write_associations(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), full, brief, ["o_orderkey", "o_totalprice"])
    read = lambda name, path: (df := t.spark.read.csv(path, sep=TAB, header=True)).agg(F.count("*").alias("n")).select(F.lit(name).alias("file"), "n", F.lit(len(df.columns)).alias("columns"))
    return read("full", full).unionByName(read("brief", brief))


@query("SELECT 'chr' || (o_custkey % 3 + 1) || chr(9) || o_orderkey || chr(9) || (o_orderkey + 5) || chr(9) || coalesce(nullif(o_orderstatus, 'F'), '.') || chr(9) || o_custkey AS line FROM orders UNION ALL SELECT '#chrom' || chr(9) || 'chromStart' || chr(9) || 'chromEnd' || chr(9) || 'name' || chr(9) || 'o_custkey'")
def bed_lines(t: Tables):
    """A BED file's own columns come first, whatever their order in the table."""
    rows = t.orders.select("o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.col("o_orderkey").alias("from"), (F.col("o_orderkey") + 5).alias("to"), _text("chr", F.col("o_custkey") % 3 + 1).alias("chromosome"))
    return S.bed_rows(rows, {"chromosome": "chrom", "from": "chromStart", "to": "chromEnd", "status": "name"}, header=True)


@query("SELECT * FROM (VALUES ('c_custkey', 'C custkey', 'number', 0), ('c_name', 'C name', 'text', 1), ('parts', 'Parts', 'json', 2)) v(\"column\", title, type, place)")
def table_columns(t: Tables):
    return S.table_view(t.customer.select("c_custkey", "c_name", F.array("c_nationkey").alias("parts")))


@query("SELECT c_name FROM customer WHERE c_custkey = 5")
def single_lookup(t: Tables):
    return S.one_record(t.customer, ["c_name"], {"c_custkey": 5})
