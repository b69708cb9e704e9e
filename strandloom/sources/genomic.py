"""Genomic file formats as DataFrames: VCF, GFF3, GAF, identifier maps, pathways, merge histories, ontologies, XML records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.regions import CHROMOSOMES, chromosome
from strandloom.functions.strings import parse_info
from strandloom.operators.annotation import allele_frequencies
from strandloom.sources.tables import read_lines
from strandloom.staging import stage

VCF = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]
GAF = [
    "db", "db_object_id", "db_object_symbol", "qualifier", "go_id", "db_reference", "evidence_code", "with_or_from", "aspect", "db_object_name",
    "db_object_synonym", "db_object_type", "taxon", "date", "assigned_by", "annotation_extension", "gene_product_form_id",
]


def _columns(lines: DataFrame, names: list[str]) -> DataFrame:
    parts = F.split("line", "\t", -1)
    return lines.select(*(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a VCF with info as a map."""
    rows = _columns(read_lines(spark, path), VCF)
    return rows.withColumns({"pos": F.col("pos").cast("long"), "id": F.when(F.col("id") != ".", F.col("id")), "info": parse_info(F.col("info"))})


def per_alt(rows: DataFrame) -> DataFrame:
    """A row for each alternative allele, with its number from 0."""
    others = [c for c in rows.columns if c != "alt"]
    return rows.select(*others, F.posexplode(F.split("alt", ",")).alias("alt_index", "alt"))


def search_vcf(rows: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    bare = F.regexp_replace("chrom", "^chr", "")
    return rows.where((bare == chrom.removeprefix("chr")) & F.col("pos").between(start, end))


def count_vcf(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """chromosome, start, end and the number of rows there, for many regions at once."""
    from strandloom.operators.intervals import point_join

    points = rows.select(F.regexp_replace("chrom", "^chr", "").alias("l_c"), F.col("pos").alias("l_p"))
    spans = regions.select(F.regexp_replace("chromosome", "^chr", "").alias("r_c"), F.col("start").alias("r_s"), F.col("end").alias("r_e"), "chromosome", "start", "end")
    found = point_join(points, spans, ("l_c", "r_c"), 1 << 16).groupBy("chromosome", "start", "end").agg(F.count("*").alias("n"))
    return regions.select("chromosome", "start", "end").distinct().join(found, ["chromosome", "start", "end"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dbsnp_frequencies(variants: DataFrame) -> DataFrame:
    """per_alt rows with the FREQ entry of the info map as population frequencies of the row's allele."""
    return variants.withColumn("allele_frequencies", allele_frequencies(F.try_element_at("info", F.lit("FREQ")), F.col("alt_index") + 1))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Features on primary contigs with attributes as a map."""
    names = ["seqid", "source", "feature_type", "start", "end", "score", "strand", "phase", "attributes"]
    rows = _columns(read_lines(spark, path), names)
    rows = rows.withColumn("chromosome", chromosome(F.col("seqid"))).where(F.col("chromosome").isin(CHROMOSOMES))
    return rows.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long"), "strand": F.when(F.col("strand") == ".", "+").otherwise(F.col("strand")), "attributes": parse_info(F.col("attributes"))})


def _attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def _bare(name: str) -> Column:
    return F.regexp_replace(_attribute(name), "^[a-zA-Z]+:", "")


def biotype(text: Column) -> Column:
    """The sequence-ontology name of a biotype; artifacts are null."""
    return F.when(text == "misc_RNA", "ncRNA_gene").when(text != "artifact", text)


def gene_models(features: DataFrame) -> DataFrame:
    """Genes with their transcripts and those with their exons and proteins, joined by Parent."""
    kind = F.col("feature_type")
    genes = features.where(F.startswith(_attribute("ID"), F.lit("gene:"))).select(_bare("ID").alias("gene_id"), _attribute("Name").alias("symbol"), biotype(_attribute("biotype")).alias("gene_type"), "chromosome", "start", "end", "strand")
    exons = features.where(kind == "exon").groupBy(_bare("Parent").alias("transcript_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce(_attribute("exon_id"), _bare("ID")).alias("exon_id")))).alias("exons"))
    proteins = features.where(kind == "CDS").groupBy(_bare("Parent").alias("transcript_id")).agg(F.array_sort(F.collect_set(F.coalesce(_attribute("protein_id"), _bare("ID")))).alias("proteins"))
    transcripts = features.where(F.startswith(_attribute("ID"), F.lit("transcript:"))).select(_bare("ID").alias("transcript_id"), _bare("Parent").alias("gene_id"), F.coalesce(F.contains(_attribute("tag"), F.lit("Ensembl_canonical")), F.lit(False)).alias("is_canonical"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    full = transcripts.join(exons, "transcript_id", "left").join(proteins, "transcript_id", "left")
    nested = full.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("transcript_id", "is_canonical", "t_start", "t_end", "exons", "proteins"))).alias("transcripts"))
    return genes.where(F.col("gene_type").isNotNull()).join(nested, "gene_id", "left")


def gene_documents(models: DataFrame) -> DataFrame:
    """chromosome and one JSON document for each gene model, for a sink that is partitioned by chromosome."""
    return models.select("chromosome", F.to_json(F.struct(*[c for c in models.columns if c != "chromosome"])).alias("document"))


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    rows = _columns(read_lines(spark, path, "!"), GAF)
    return rows.withColumn("with_or_from", F.filter(F.split("with_or_from", r"\|"), lambda x: x != ""))


def evidence_sets(gaf: DataFrame) -> DataFrame:
    """Distinct evidence of each gene product and term."""
    evidence = F.concat_ws(";", "evidence_code", "qualifier", "db_reference")
    return gaf.groupBy("db_object_id", "go_id").agg(F.array_sort(F.collect_set(evidence)).alias("evidence"))


def read_hgnc(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the nomenclature file that name an Ensembl gene."""
    return spark.read.json(path, multiLine=True).select(F.explode("response.docs").alias("d")).select("d.*").where("ensembl_gene_id is not null")


#: Keys that are no cross references, and categories of the others.
XREF_SKIP = ["status", "uuid", "location_sortable", "curator_notes"]
XREF_CATEGORIES = {
    "identifier": ["hgnc_id", "entrez_id", "ensembl_gene_id", "refseq_accession", "uniprot_ids", "vega_id", "ucsc_id"],
    "ortholog": ["mgd_id", "rgd_id"],
    "publication": ["pubmed_id"],
    "locus": ["location"],
    "classification": ["locus_type", "locus_group"],
    "group_membership": ["gene_group", "gene_group_id"],
    "nomenclature": ["symbol", "name", "alias_symbol", "alias_name", "prev_symbol", "prev_name"],
}


def _cell(group: str, label: str):
    return lambda v: F.struct(F.lit(group).alias("category"), F.lit(label).alias("label"), v.alias("value"))


def unpivot_xrefs(docs: DataFrame, key: str = "ensembl_gene_id") -> DataFrame:
    """gene, category, label and value rows of wide documents; lists become rows, blanks and dates are left out."""
    category = {label: name for name, labels in XREF_CATEGORIES.items() for label in labels}
    cells = []
    for name, kind in docs.dtypes:
        if name.startswith("date_") or name in (*XREF_SKIP, key):
            continue
        values = F.transform(F.col(name), lambda x: x.cast("string")) if kind.startswith("array") else F.array(F.col(name).cast("string"))
        label = f"{name[:-4]}_id" if name.endswith("_ids") else name
        group = category.get(name.replace(".", "_").replace("-", "_"), "resource_link")
        cells.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), _cell(group, label)))
    rows = docs.select(F.col(key).alias("gene_id"), F.explode(F.flatten(F.array(*cells))).alias("x"))
    return rows.select("gene_id", "x.*").where(F.trim("value") != "")


def strip_version(text: Column) -> Column:
    """Ensembl gene and protein ids without `.version`; others as they are."""
    return F.regexp_replace(text, r"^(ENS[GP]\d+)\.\d+$", "$1")


def read_id_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Protein to Ensembl links, each once."""
    rows = spark.read.csv(path, sep="\t", schema="uniprot_id string, id_type string, mapped_id string")
    return rows.where(F.col("id_type").isin("Ensembl", "Ensembl_PRO")).withColumn("mapped_id", strip_version(F.col("mapped_id"))).dropDuplicates()


def read_kgml(spark: SparkSession, path: str) -> DataFrame:
    """pathway_id, pathway_name and gene rows of pathway files."""
    raw = spark.read.format("xml").option("rowTag", "pathway").load(path)
    entries = raw.select(F.col("_name").alias("pathway_id"), F.col("_title").alias("pathway_name"), F.explode("entry").alias("e")).where("e._type = 'gene'")
    return entries.select("pathway_id", "pathway_name", F.explode(F.split("e._name", r"\s+")).alias("gene")).dropDuplicates()


def read_reactome(spark: SparkSession, path: str, species: str = "Homo sapiens") -> DataFrame:
    """Genes of each pathway of a species."""
    lines = read_lines(spark, path)
    whole = F.when(F.size(F.split("line", "\t", -1)) != 6, F.raise_error(F.concat(F.lit("no pathway line of six fields: "), F.col("line")))).otherwise(F.col("line"))
    rows = _columns(lines.select(whole.alias("line")), ["gene_id", "pathway_id", "pathway_url", "pathway_name", "evidence_code", "species"])
    kept = rows.where((F.col("species") == species) & F.startswith("gene_id", F.lit("ENSG")))
    return kept.groupBy("pathway_id", "pathway_name").agg(F.array_sort(F.collect_set("gene_id")).alias("genes"))


def utc(text: Column) -> Column:
    """A time stamp with zone as UTC without one."""
    return F.date_format(F.to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss")


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """Merged identifiers with what they became and their history."""
    schema = "refsnp_id string, dbsnp1_merges array<struct<merged_rsid: string, revision: string, merge_date: string>>, merged_snapshot_data struct<merged_into: array<string>, proxy_build_id: string, proxy_time: string>"
    rows = spark.read.schema(schema).json(path).where(F.size("merged_snapshot_data.merged_into") > 0)
    history = F.transform("dbsnp1_merges", lambda m: F.struct(F.concat(F.lit("rs"), m["merged_rsid"]).alias("ref_snp_id"), m["revision"].alias("build"), utc(m["merge_date"]).alias("merge_date")))
    return rows.select(F.concat(F.lit("rs"), "refsnp_id").alias("ref_snp_id"), F.concat(F.lit("rs"), F.get("merged_snapshot_data.merged_into", F.lit(0))).alias("merged_into"), history.alias("history"))


def resolve_merges(aliases: DataFrame) -> DataFrame:
    """ref_snp_id and the identifier at the end of its chain of merges, null where the chain runs into a cycle and so has no end. Pointers are doubled; each round is written once, and as many rounds as the longest chain can need end it."""
    links = stage(aliases.select("ref_snp_id", "merged_into"), "merges")
    for _ in range(max(1, links.count()).bit_length() + 1):
        nxt = links.select(F.col("ref_snp_id").alias("merged_into"), F.col("merged_into").alias("_next"))
        joined = stage(links.join(nxt, "merged_into", "left"), "merges")
        if joined.where("_next is not null").isEmpty():
            return links
        links = joined.select("ref_snp_id", F.coalesce("_next", "merged_into").alias("merged_into"))
    return joined.select("ref_snp_id", F.when(F.col("_next").isNull(), F.col("merged_into")).alias("merged_into"))


def read_owl(spark: SparkSession, path: str) -> DataFrame:
    """curie, term, definition and synonyms of the classes of an RDF/XML ontology."""
    schema = "`_rdf:about` string, `rdfs:label` string, `obo:IAO_0000115` string, `oboInOwl:hasExactSynonym` array<string>"
    raw = spark.read.format("xml").option("rowTag", "owl:Class").schema(schema).load(path).where("`_rdf:about` is not null")
    curie = F.replace(F.substring_index("_rdf:about", "/", -1), F.lit("_"), F.lit(":"))
    return raw.select(curie.alias("curie"), F.col("`_rdf:about`").alias("term_iri"), F.coalesce("`rdfs:label`", curie).alias("term"), F.col("`obo:IAO_0000115`").alias("definition"), F.array_sort(F.col("`oboInOwl:hasExactSynonym`")).alias("synonyms"))


def read_owl_triples(spark: SparkSession, path: str) -> DataFrame:
    """subject, predicate and object of the superclasses and annotations of an ontology's classes."""
    schema = "`_rdf:about` string, `rdfs:subClassOf` array<struct<`_rdf:resource`: string>>, `rdfs:label` string, `obo:IAO_0000115` string, `oboInOwl:hasExactSynonym` array<string>"
    raw = spark.read.format("xml").option("rowTag", "owl:Class").schema(schema).load(path).where("`_rdf:about` is not null")
    curie = lambda c: F.replace(F.substring_index(c, "/", -1), F.lit("_"), F.lit(":"))
    said = lambda p, c: F.when(c.isNotNull(), F.struct(F.lit(p).alias("predicate"), c.alias("object")))
    listed = lambda p, c, f: F.transform(F.coalesce(c, F.array().cast(f)), lambda x: F.struct(F.lit(p).alias("predicate"), (x if f == "array<string>" else curie(x["_rdf:resource"])).alias("object")))
    single = F.array_compact(F.array(said("label", F.col("`rdfs:label`")), said("definition", F.col("`obo:IAO_0000115`"))))
    supers = listed("subClassOf", F.filter("`rdfs:subClassOf`", lambda x: x["_rdf:resource"].isNotNull()), "array<struct<`_rdf:resource`: string>>")
    synonyms = listed("synonym", F.col("`oboInOwl:hasExactSynonym`"), "array<string>")
    return raw.select(curie(F.col("`_rdf:about`")).alias("subject"), F.explode(F.concat(single, supers, synonyms)).alias("t")).select("subject", "t.*")


def term_fallbacks(triples: DataFrame) -> DataFrame:
    """curie, term and definition of the subjects of triples: the label, else a synonym, else the curie; the definition, else the label."""
    best = lambda p: F.min(F.when(F.col("predicate") == p, F.col("object")))
    rows = triples.groupBy(F.col("subject").alias("curie")).agg(best("label").alias("label"), best("synonym").alias("synonym"), best("definition").alias("definition"))
    return rows.select("curie", F.coalesce("label", "synonym", "curie").alias("term"), F.coalesce("definition", "label").alias("definition"))


def read_xml_records(spark: SparkSession, path: str) -> DataFrame:
    """schema, table, record number and a map of fields of generic record files; a field that comes twice in a record is an error."""
    schema = "_schema string, _name string, Record array<struct<Field: array<struct<_name: string, _VALUE: string>>>>"
    raw = spark.read.format("xml").option("rowTag", "Table").schema(schema).load(path)
    rows = raw.select(F.col("_schema").alias("schema"), F.col("_name").alias("table"), F.posexplode("Record").alias("record", "r"))
    pairs = F.transform("r.Field", lambda f: F.struct(f["_name"].alias("key"), F.trim(f["_VALUE"]).alias("value")))
    return rows.select("schema", "table", "record", F.map_from_entries(pairs).alias("fields"))
