"""Association statistics: harmonisation, categories, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def harmonise(rows: DataFrame) -> DataFrame:
    """test_allele, effect and non_ref_af by the reference and alternative alleles: where the reference was tested, the alternative is, with the sign turned and the frequency taken from 1."""
    flipped = F.col("test_allele") == F.col("ref")
    return rows.withColumns(
        {
            "harmonised_allele": F.when(flipped, F.col("alt")).otherwise(F.col("test_allele")),
            "harmonised_effect": F.when(flipped, -F.col("effect")).otherwise(F.col("effect")),
            "non_ref_af": F.when(flipped, 1 - F.col("frequency")).otherwise(F.col("frequency")),
        }
    )


def allele_status(rs_id: Column, ref: Column, alt: Column, genome_ref: Column, lifted: Column) -> Column:
    """valid, swapped, unverified or dropped."""
    snv = (F.length(ref) == 1) & (F.length(alt) == 1)
    return (
        F.when(rs_id.isNotNull(), "valid")
        .when(ref == genome_ref, "valid")
        .when((alt == genome_ref) & snv, "swapped")
        .when(alt == genome_ref, "unverified")
        .when(lifted, "dropped")
        .otherwise("unverified")
    )


def trait_category(trait: Column) -> Column:
    """The first that fits: AD, Biomarker, ADRD, Other."""
    low = F.lower(trait)
    return F.when(low.contains("alzheimer"), "AD").when(low.contains("biomarker"), "Biomarker").when(low.rlike("dementia|parkinson|palsy"), "ADRD").otherwise("Other")


def resolve_trait(trait: Column, disease: Column, neuropathology: Column, biomarker: Column) -> Column:
    first = lambda a: F.get(a, F.lit(0))
    return F.coalesce(trait, first(disease), first(neuropathology), first(biomarker))


def association_counts(rows: DataFrame, category: str, trait: str) -> DataFrame:
    return rows.groupBy(category, trait).agg(F.count("*").alias("num_associations"))


def association_counts_by_position(rows: DataFrame, category: str, trait: str, position: str, positions: list[str]) -> DataFrame:
    """One count for each position and their total."""
    at = [F.count(F.when(F.col(position) == p, 1)).alias(p.replace(" ", "_")) for p in positions]
    return rows.groupBy(category, trait).agg(*at, F.count("*").alias("total"))


def in_accession(column: Column, accession: str) -> Column:
    return F.startswith(column, F.lit(accession))
