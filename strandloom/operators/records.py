"""Lookups of genes, variants, regions and tracks: what a text names, where that is, and the records there.

Every lookup takes a table of what is asked, so one id and a million are the same
plan: an equality join on normalised names, or the interval join."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import regions as R
from strandloom.functions import variants as V
from strandloom.functions.patterns import PATTERNS
from strandloom.operators.intervals import overlap_join
from strandloom.operators.paging import PAGE_SIZE, page

REGION, VARIANT, GENE = "region", "variant", "gene"
BUCKET = 1 << 16


def infer_location(text: Column) -> Column:
    """kind and normalised id of a text, and chromosome, start and end of a region: a region (chrN:start-end, N:start-end, chrN-start-end) with start <= end, else a variant (positional with a known chromosome, refSNP, structural), else a gene's name; null if it is none."""
    span = F.when(F.size(F.split(text, "-")) > 2, F.regexp_replace(text, r"^([^-]*)-", "$1:")).otherwise(text)
    shape = r"^(.+):(\d+)-(\d+)$"
    chrom = R.chromosome(F.nullif(F.regexp_extract(span, shape, 1), F.lit("")))
    start, end = (F.regexp_extract(span, shape, k).try_cast("long") for k in (2, 3))
    is_region = F.coalesce(F.rlike(span, F.lit(shape)) & chrom.isNotNull() & (start <= end), F.lit(False))
    positional = F.rlike(text, F.lit(PATTERNS["positional_variant"])) & R.chromosome(F.split_part(text, F.lit(":"), F.lit(1))).isNotNull()
    snp, sv = F.rlike(F.lower(text), F.lit(PATTERNS["ref_snp"])), F.rlike(F.upper(text), F.lit(PATTERNS["structural_variant"]))
    field = lambda kind, name, chrom=None, s=None, e=None: F.struct(
        F.lit(kind).alias("kind"), name.alias("id"), *(F.lit(None).cast(t).alias(n) if c is None else c.cast(t).alias(n) for n, c, t in (("chromosome", chrom, "string"), ("start", s, "long"), ("end", e, "long")))
    )
    return (
        F.when(is_region, field(REGION, R.format_region(chrom, start, end), chrom, start, end))
        .when(positional, field(VARIANT, text))
        .when(snp, field(VARIANT, F.lower(text)))
        .when(sv, field(VARIANT, F.upper(text)))
        .when(F.rlike(text, F.lit(PATTERNS["gene"])), field(GENE, text))
    )


def feature_errors(text: Column, kind: str) -> Column:
    """What is wrong with an id of a kind; null if nothing is."""
    found = infer_location(text)
    says = {REGION: "no region; write chrN:start-end with start <= end", VARIANT: "no variant; write a refSNP id, a structural id or chr:pos:ref:alt", GENE: "no gene; write an Ensembl id, a symbol or an Entrez id"}
    ok = F.rlike(text, F.lit(PATTERNS["gene"])) if kind == GENE else F.coalesce(found["kind"] == kind, F.lit(False))
    return F.when(~ok, F.concat(text, F.lit(": "), F.lit(says[kind])))


def gene_matches(asked: DataFrame, genes: DataFrame) -> DataFrame:
    """asked (key) with the genes of that symbol (in any case), Ensembl id or Entrez id. genes: gene_id, symbol, entrez_id and others."""
    name = lambda kind, c: F.struct(F.lit(kind).alias("of"), c.cast("string").alias("name"))
    named = genes.withColumn("_n", F.explode(F.array(name("symbol", F.upper("symbol")), name("id", F.col("gene_id")), name("entrez", F.col("entrez_id")))))
    keys = asked.select("key").where("key IS NOT NULL").distinct().withColumn("_n", F.explode(F.array(name("symbol", F.upper("key")), name("id", F.col("key")), name("entrez", F.col("key")))))
    return keys.join(named, "_n").drop("_n").dropDuplicates(["key", "gene_id"])


def variant_matches(asked: DataFrame, variants: DataFrame) -> DataFrame:
    """asked (key) with the variants of that id, refSNP id (in any case) or id with its alleles exchanged (`swapped` says so). variants: variant_id, ref_snp_id and others."""
    name = lambda of, c, swapped: F.struct(F.lit(of).alias("of"), c.alias("name"), F.lit(swapped).alias("swapped"))
    named = variants.withColumn("_n", F.explode(F.array(name("id", F.col("variant_id"), False), name("snp", F.col("ref_snp_id"), False))))
    positional = F.rlike("key", F.lit(PATTERNS["positional_variant"]))
    ways = F.array(name("id", F.col("key"), False), name("snp", F.lower("key"), False), F.when(positional, name("id", V.swap_alleles(F.col("key")), True)))
    keys = asked.select("key").where("key IS NOT NULL").distinct().withColumn("_w", F.explode(F.array_compact(ways)))
    joined = keys.join(named, (keys["_w.of"] == named["_n.of"]) & (keys["_w.name"] == named["_n.name"]))
    found = joined.select("key", F.col("_w.swapped").alias("swapped"), *[named[c] for c in variants.columns])
    # An id that is there as it stands is not looked for with its alleles exchanged.
    return found.join(found.where("NOT swapped").select("key").distinct().withColumn("_plain", F.lit(True)), "key", "left").where(~F.col("swapped") | F.col("_plain").isNull()).drop("_plain").dropDuplicates(["key", "variant_id"])


def variant_span(identifier: Column) -> Column:
    """chr:pos-1-pos of chr:pos:ref:alt, as a zero-based span that holds the variant."""
    p = V.positional_parts(identifier)
    return F.when(p.isNotNull(), F.concat(p["chromosome"], F.lit(":"), (p["position"] - 1).cast("string"), F.lit("-"), p["position"].cast("string")))


def locations(asked: DataFrame, genes: DataFrame, variants: DataFrame) -> DataFrame:
    """asked (key) with kind, chromosome, start and end of every feature that it names; a key without any has null. A variant reaches from its position over its length."""
    told = asked.select("key").distinct().withColumn("_l", infer_location(F.col("key")))
    regions = told.where(F.col("_l.kind") == REGION).select("key", "_l.kind", "_l.chromosome", "_l.start", "_l.end")
    of = lambda kind: told.where(F.col("_l.kind") == kind).select("key")
    g = gene_matches(of(GENE), genes).select("key", F.lit(GENE).alias("kind"), "chromosome", "start", "end")
    v = variant_matches(of(VARIANT), variants).select("key", F.lit(VARIANT).alias("kind"), "chromosome", F.col("position").alias("start"), (F.col("position") + F.col("length")).alias("end"))
    return told.select("key").join(regions.unionByName(g).unionByName(v), "key", "left")


def in_regions(asked: DataFrame, features: DataFrame, width: int | None = BUCKET) -> DataFrame:
    """key, feature columns and relation for the features (chromosome, start, end and others) that overlap regions asked for (key, chromosome, start, end)."""
    left = asked.select("key", F.col("chromosome").alias("l_c"), F.col("start").alias("l_s"), F.col("end").alias("l_e"))
    right = features.withColumns({"r_c": F.col("chromosome"), "r_s": F.col("start"), "r_e": F.col("end")})
    both = overlap_join(left, right, ("l_c", "r_c"), width)
    return both.select("key", *features.columns, R.range_relation(F.col("r_s"), F.col("r_e"), F.col("l_s"), F.col("l_e")).alias("relation"))


def oriented(identifier: Column, test_allele: Column) -> Column:
    """A positional id whose alternative is the tested allele."""
    return F.when(F.split_part(identifier, F.lit(":"), F.lit(4)) == test_allele, identifier).otherwise(V.swap_alleles(identifier))


def variant_list(asked: DataFrame, variants: DataFrame, of: str) -> DataFrame:
    """key and variant_id of the variants of a resource ("adsp": flagged as such; "dbsnp": with a refSNP id) in regions asked for (key, chromosome, start, end)."""
    mine = variants.where(F.coalesce("is_adsp_variant", F.lit(False)) if of == "adsp" else F.col("ref_snp_id").isNotNull())
    spans = mine.withColumns({"start": F.col("position"), "end": F.col("position") + F.col("length") - 1})
    return in_regions(asked, spans).select("key", "variant_id")


def variant_details(variants: DataFrame, genes: DataFrame) -> DataFrame:
    """What a page shows of variants (variant_id, ref_snp_id, variant_class, is_adsp_variant, consequence, impact, impacted_gene, is_coding): one struct `details` beside variant_id. A gene that is not known is null."""
    symbol = genes.select(F.col("gene_id").alias("_g"), F.col("symbol").alias("_symbol"))
    rows = variants.join(symbol, F.col("impacted_gene") == F.col("_g"), "left")
    gene = F.when(F.col("_symbol").isNotNull(), F.struct(F.col("_g").alias("ensembl_id"), F.col("_symbol").alias("gene_symbol")))
    worst = F.struct("consequence", "impact", gene.alias("impacted_gene"), "is_coding")
    return rows.select("variant_id", F.struct("ref_snp_id", F.col("variant_class").alias("type"), F.coalesce("is_adsp_variant", F.lit(False)).alias("is_adsp_variant"), worst.alias("most_severe_consequence")).alias("details"))


def qtl_rows(qtls: DataFrame, genes: DataFrame, details: DataFrame) -> DataFrame:
    """QTLs (track_id, rank, variant_id, test_allele, target and others) with their target gene and variant; QTLs of unknown genes are left out."""
    target = genes.select(F.col("gene_id").alias("target"), F.struct(F.col("gene_id").alias("ensembl_id"), F.col("symbol").alias("gene_symbol")).alias("target_gene"))
    rows = qtls.join(target, "target").join(details, "variant_id", "left")
    return rows.withColumn("variant_id", oriented(F.col("variant_id"), F.col("test_allele")))


def data_source(name: str, column: Column) -> Column:
    """A row's content with the name of where it comes from."""
    return F.to_json(F.struct(F.lit(name).alias("datasource"), column.alias("value")))


@dataclass
class Store:
    """The tables behind the entry functions. genes: gene_id, symbol, entrez_id, chromosome, start, end; variants: variant_id, ref_snp_id, chromosome, position, length; tracks: track_id and others; hits: track_id, chromosome, start, end and others; associations: gene_id or variant_id, p_value and others."""

    genes: DataFrame
    variants: DataFrame
    tracks: DataFrame | None = None
    hits: DataFrame | None = None
    associations: DataFrame | None = None
    size: int = PAGE_SIZE

    def _one(self, key: str) -> DataFrame:
        return self.genes.sparkSession.createDataFrame(pa.table({"key": pa.array([key], pa.string())}))

    def gene(self, key: str) -> DataFrame:
        """The record of a gene by symbol, Ensembl id or Entrez id."""
        return gene_matches(self._one(key), self.genes).drop("key")

    def variant(self, key: str) -> DataFrame:
        """The record of a variant by refSNP id, structural id or positional id, in either order of its alleles."""
        return variant_matches(self._one(key), self.variants).drop("key")

    def location(self, text: str) -> DataFrame:
        """Where a gene, variant or region is."""
        return locations(self._one(text), self.genes, self.variants)

    def region(self, text: str, kind: str = GENE) -> DataFrame:
        """The genes or variants that overlap what a text names."""
        where = self.location(text).where("chromosome IS NOT NULL")
        features = self.genes if kind == GENE else self.variants.withColumns({"start": F.col("position"), "end": F.col("position") + F.col("length")})
        return in_regions(where, features).drop("key")

    def track(self, *ids: str) -> DataFrame:
        """Tracks by id; an id that isn't there comes back with `found` false."""
        asked = self.genes.sparkSession.createDataFrame([(i,) for i in ids], "track_id string").distinct()
        return asked.join(self.tracks.withColumn("found", F.lit(True)), "track_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def track_hits(self, text: str, *ids: str, number: int = 0) -> DataFrame:
        """A page of the hits of tracks in what a text names, in order of track and place."""
        where = self.location(text).where("chromosome IS NOT NULL")
        mine = self.hits.where(F.col("track_id").isin(*ids)) if ids else self.hits
        return page(in_regions(where, mine).drop("key"), [F.col("track_id"), F.col("start"), F.col("end")], number, self.size)

    def informative(self, text: str) -> DataFrame:
        """Tracks with hits in what a text names, by falling number of them."""
        where = self.location(text).where("chromosome IS NOT NULL")
        return in_regions(where, self.hits).groupBy("track_id").agg(F.count("*").alias("num_overlaps")).orderBy(F.desc("num_overlaps"), "track_id")

    def gene_associations(self, key: str, number: int = 0) -> DataFrame:
        """A page of the associations of a gene, the most significant first."""
        found = self.associations.join(self.gene(key).select("gene_id"), "gene_id")
        return page(found, [F.col("p_value"), *(F.col(c) for c in found.columns if c != "p_value")], number, self.size)

    def search(self, text: str, most: int | None = None) -> DataFrame:
        """What a text finds: a region's genes and variants, else genes and variants of that name; at most so many, each with the number that there are."""
        told = self._one(text).select(infer_location(F.col("key")).alias("l")).first()["l"]  # of a local row: no job runs
        named = told is None or told["kind"] != REGION
        genes, variants = (self.gene(text), self.variant(text)) if named else (self.region(text), self.region(text, VARIANT))
        g = genes.select(F.lit(GENE).alias("record_type"), F.col("gene_id").alias("id"), F.col("symbol").alias("display"))
        v = variants.select(F.lit(VARIANT).alias("record_type"), F.col("variant_id").alias("id"), F.coalesce("ref_snp_id", "variant_id").alias("display"))
        found = g.unionByName(v)
        counted = found.crossJoin(found.agg(F.count("*").alias("num_results")))  # one row
        ordered = counted.orderBy("record_type", "display", "id")
        return ordered if most is None else ordered.limit(most)
