"""Consequence ranking, VEP documents and allele frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.staging import stage

#: Consequence terms by group, most severe first.
HIGH_IMPACT = [
    "transcript_ablation", "splice_acceptor_variant", "splice_donor_variant", "stop_gained", "frameshift_variant", "stop_lost", "start_lost", "inframe_insertion",
    "inframe_deletion", "missense_variant", "protein_altering_variant", "splice_region_variant", "incomplete_terminal_codon_variant", "stop_retained_variant",
    "start_retained_variant", "synonymous_variant", "coding_sequence_variant", "5_prime_UTR_variant", "3_prime_UTR_variant", "regulatory_region_ablation",
]
NMD = ["NMD_transcript_variant"]
NON_CODING = ["non_coding_transcript_exon_variant", "non_coding_transcript_variant"]
MODIFIER = [
    "intron_variant", "mature_miRNA_variant", "non_coding_transcript_variant", "non_coding_transcript_exon_variant", "upstream_gene_variant", "downstream_gene_variant",
    "TF_binding_site_variant", "TFBS_ablation", "TFBS_amplification", "TF_binding_site_variant", "regulatory_region_amplification", "regulatory_region_variant", "intergenic_variant",
]
GROUPS = {"HIGH_IMPACT": HIGH_IMPACT, "NMD": NMD, "NON_CODING_TRANSCRIPT": NON_CODING, "MODIFIER": MODIFIER}
#: Terms that change coding sequence.
CODING = [
    "synonymous_variant", "missense_variant", "inframe_insertion", "inframe_deletion", "stop_gained", "stop_lost", "stop_retained_variant", "start_lost",
    "frameshift_variant", "coding_sequence_variant", "protein_altering_variant", "incomplete_terminal_codon_variant",
]
#: Kinds of consequences in the order in which the most severe one is looked for.
KINDS = ("transcript", "regulatory_feature", "motif_feature", "intergenic")


def is_coding(terms: Column) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, CODING)))


def combo_key(terms: Column) -> Column:
    """One text for each multiset of terms."""
    return F.array_join(F.array_sort(terms), ",")


def _letters(terms: Column, places: dict[str, int]) -> Column:
    """Sorted letters of the terms' places in a group's list."""
    table = F.create_map(*(x for k, v in places.items() for x in (F.lit(k), F.lit(v))))
    return F.array_join(F.array_sort(F.transform(terms, lambda t: F.char(64 + F.element_at(table, t)))), "")


def _members(terms: Column, group: str) -> Column:
    own = F.array(*map(F.lit, dict.fromkeys(GROUPS[group])))
    if group == "MODIFIER":
        return F.size(F.array_except(terms, own)) == 0
    inside = F.arrays_overlap(terms, own)
    if group == "HIGH_IMPACT":
        inside &= ~F.arrays_overlap(terms, F.array(*map(F.lit, [*NMD, *NON_CODING])))
    return inside


def rank_combos(combos: DataFrame) -> DataFrame:
    """key and rank (from 1) of term combinations (terms: array). Groups follow each other; within one the first letter counts, then more terms, then the letters. A combination of several groups keeps its last rank. The number of combinations is that of distinct annotations: hundreds."""
    complete = {t: k + 1 for k, t in enumerate([*HIGH_IMPACT, *NMD, *MODIFIER])}
    rows = combos.select(combo_key(F.col("terms")).alias("key"), "terms").dropDuplicates(["key"])
    parts = None
    for order, group in enumerate(GROUPS):
        places = {t: k + 1 for k, t in enumerate(GROUPS[group])} if group in ("HIGH_IMPACT", "MODIFIER") else complete
        letters = _letters(F.col("terms"), places)
        part = rows.where(_members(F.col("terms"), group)).select("key", F.lit(order).alias("grp"), letters.alias("letters"))
        parts = part if parts is None else parts.unionByName(part)
    place = F.row_number().over(Window.orderBy("grp", F.substring("letters", 1, 1), F.desc(F.length("letters")), "letters", "key"))
    ranked = parts.withColumn("place", place)
    last = ranked.groupBy("key").agg(F.max("place").alias("place"))
    return last.select("key", F.row_number().over(Window.orderBy("place")).alias("rank"))


def default_combos(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """Every single term, and the combinations of extra (terms)."""
    single = spark.createDataFrame([([t],) for t in dict.fromkeys([*HIGH_IMPACT, *NMD, *MODIFIER])], "terms array<string>")
    return single if extra is None else single.unionByName(extra.select("terms"))


def rank_consequences(annotations: DataFrame, ranks: DataFrame) -> DataFrame:
    """annotations (terms) with rank; combinations that the table (key, rank) lacks are added and all are ranked anew."""
    rows = annotations.withColumn("_key", combo_key(F.col("terms")))
    table = extended_ranks(annotations, ranks)
    return rows.join(table, rows["_key"] == table["key"], "left").drop("_key", "key")


def extended_ranks(annotations: DataFrame, ranks: DataFrame) -> DataFrame:
    """The table of ranks, or a new one if annotations (terms) hold combinations that it lacks: of these and of its own."""
    asked = annotations.select(combo_key(F.col("terms")).alias("key")).where("key IS NOT NULL").distinct()
    missing = stage(asked.join(ranks, "key", "left_anti"), "combos")  # distinct annotations: hundreds
    if missing.isEmpty():
        return ranks
    return stage(rank_combos(ranks.select("key").unionByName(missing).select(F.split("key", ",").alias("terms"))), "ranks")


def most_severe(consequences: DataFrame, allele: list[str]) -> DataFrame:
    """One consequence for each allele: by kind, then rank, then the annotator's order. consequences: allele columns, kind, rank, vep_order."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    first = Window.partitionBy(*allele).orderBy(kind, "rank", "vep_order")
    return consequences.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def split_frequencies(frequencies: Column) -> Column:
    """A map of population frequencies by project."""
    gnomad, esp = (lambda k, v: F.contains(k, F.lit("gnomad"))), (lambda k, v: k.isin("aa", "ea"))
    rest = lambda k, v: ~(F.contains(k, F.lit("gnomad")) | k.isin("aa", "ea"))
    return F.struct(F.map_filter(frequencies, gnomad).alias("GnomAD"), F.map_filter(frequencies, esp).alias("ESP"), F.map_filter(frequencies, rest).alias("1000Genomes"))


def colocated_frequencies(colocated: Column) -> Column:
    """Frequencies of the last colocated variant that has any and is no COSMIC one; a single one isn't tested for COSMIC."""
    with_any = F.filter(colocated, lambda v: v["frequencies"].isNotNull() & ((F.size(colocated) == 1) | ~F.startswith(v["id"], F.lit("COSV"))))
    return F.try_element_at(with_any, F.lit(-1))["frequencies"]


def allele_frequencies(text: Column, index: Column) -> Column:
    """A map of population to frequency from `pop:ref,alt1,alt2|...`: the index-th alternative, without missing ones."""
    pairs = F.transform(
        F.split(text, r"\|"),
        lambda p: F.struct(F.substring_index(p, ":", 1).alias("key"), F.get(F.split(F.substring_index(p, ":", -1), ","), index).try_cast("double").alias("value")),
    )
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def frequency_rows(variants: DataFrame, column: str = "allele_frequencies") -> DataFrame:
    """source, population and frequency rows of nested frequency maps."""
    outer = variants.select(*[c for c in variants.columns if c != column], F.explode(column).alias("datasource", "populations"))
    return outer.select(*[c for c in outer.columns if c != "populations"], F.explode("populations").alias("population", "frequency"))


def with_populations(rows: DataFrame, populations: DataFrame) -> DataFrame:
    """frequency_rows with the display name of their population (populations: datasource, source_id, display_name), by source and id; an unknown population keeps its id."""
    known = populations.select("datasource", F.col("source_id").alias("population"), "display_name")
    return rows.join(known, ["datasource", "population"], "left").withColumn("display_name", F.coalesce("display_name", "population"))


def ranked_document(consequences: DataFrame, ranks: DataFrame, key: list[str]) -> DataFrame:
    """key, allele and an array of consequences for each kind, by rank then the annotator's order. consequences: key columns, kind, allele, terms and vep_order; combinations that the table lacks are ranked anew."""
    rows = rank_consequences(consequences, ranks)
    item = F.struct("rank", "vep_order", "terms", is_coding(F.col("terms")).alias("is_coding"))
    wanted = [F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item))).alias(kind) for kind in KINDS]
    return rows.groupBy(*key, "allele").agg(*wanted)  # a variant's consequences


#: Colours of the impacts on pages.
IMPACT_COLOURS = {"HIGH": "#ff00ff", "MODERATE": "#f59300", "LOW": "#377eb8", "MODIFIER": "#377eb8"}


def consequence_summary(terms: Column, impact: Column, gene_id: Column, gene_symbol: Column, transcript: Column | None = None, codons: Column | None = None, amino_acids: Column | None = None) -> Column:
    """What a page says of a predicted consequence: terms, impact with its colour (null for an unknown one), whether it is coding, gene (null without an id), transcript, codon and amino acid change."""
    table = F.create_map(*(x for k, v in IMPACT_COLOURS.items() for x in (F.lit(k), F.lit(v))))
    known = F.when(F.upper(impact).isin(*IMPACT_COLOURS), F.upper(impact))
    none = F.lit(None).cast("string")
    gene = F.when(gene_id.isNotNull(), F.struct(gene_id.alias("id"), gene_symbol.alias("gene_symbol")))
    rest = [(none if c is None else c).alias(n) for n, c in (("impacted_transcript", transcript), ("codon_change", codons), ("amino_acid_change", amino_acids))]
    return F.struct(terms.alias("consequence_terms"), known.alias("impact"), F.try_element_at(table, known).alias("colour"), is_coding(terms).alias("is_coding"), gene.alias("impacted_gene"), *rest)
