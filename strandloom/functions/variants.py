"""Variant identity: classes, lengths, identifiers, alleles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.patterns import PATTERNS

SV_LENGTH = 50
MOST_BASES_IN_ID = 20


def variant_class(ref: Column, alt: Column, given: Column | None = None) -> Column:
    """By allele lengths; a structural variant keeps its given class."""
    r, a = F.length(ref), F.length(alt)
    kind = F.when(r == 1, "INS").when(a == 1, "DEL").otherwise("INDEL")
    structural = F.coalesce(given, kind) if given is not None else kind
    return (
        F.when((r >= SV_LENGTH) | (a >= SV_LENGTH), structural)
        .when((r == 1) & (a == 1), "SNV")
        .when(r == a, "MNV")
        .otherwise(F.concat(F.lit("SHORT_"), kind))
    )


def variant_length(ref: Column, alt: Column) -> Column:
    r, a, kind = F.length(ref), F.length(alt), variant_class(ref, alt)
    return F.when(kind.isin("SNV", "MNV"), r).when(kind == "SHORT_INS", a - r).when(kind == "SHORT_DEL", r - a).otherwise(F.abs(r - a))


def span_end(position: Column, ref: Column, alt: Column) -> Column:
    return position + variant_length(ref, alt) - 1


def positional_parts(identifier: Column) -> Column:
    """chromosome, position, ref and alt of chr:pos:ref:alt or chr-pos-ref-alt; null if there are not four."""
    parts = F.split(F.replace(identifier, F.lit("-"), F.lit(":")), ":")
    fields = F.struct(F.get(parts, F.lit(0)).alias("chromosome"), F.get(parts, F.lit(1)).try_cast("long").alias("position"), F.get(parts, F.lit(2)).alias("ref"), F.get(parts, F.lit(3)).alias("alt"))
    return F.when(F.size(parts) == 4, fields)


def swap_alleles(identifier: Column) -> Column:
    """chr:pos:ref:alt with the alleles exchanged."""
    p = lambda k: F.split_part(identifier, F.lit(":"), F.lit(k))
    return F.concat_ws(":", p(1), p(2), p(4), p(3))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


def ref_snp(identifier: Column) -> Column:
    return F.when(F.startswith(identifier, F.lit("rs")), identifier).otherwise(F.concat(F.lit("rs"), identifier))


def normalised_alleles(ref: Column, alt: Column) -> Column:
    """Alleles without their common prefix, then their common suffix; `-` where nothing is left."""

    def common(a: Column, b: Column) -> Column:
        step = lambda n, i: F.when((n == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(n)
        least = F.least(F.length(a), F.length(b))
        return F.when(least > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), F.lit(0), step)).otherwise(0)

    head = common(ref, alt)
    r, a = F.substr(ref, head + 1), F.substr(alt, head + 1)
    tail = common(F.reverse(r), F.reverse(a))
    cut = lambda x: F.substr(x, F.lit(1), F.length(x) - tail)
    dash = lambda x: F.when(x == "", "-").otherwise(x)
    return F.struct(dash(cut(r)).alias("ref"), dash(cut(a)).alias("alt"))


def nomenclature(identifier: Column) -> Column:
    """The notation of a variant identifier."""
    is_ = lambda name: F.rlike(identifier, F.lit(PATTERNS[name]))
    return (
        F.when(is_("positional_variant"), "POSITIONAL")
        .when(is_("gnomad"), "GNOMAD")
        .when(is_("ref_snp"), "REFSNP")
        .when(is_("structural_variant"), "SV")
        .when(is_("spdi"), "SPDI")
        .when(is_("beacon"), "BEACON")
        .when(is_("hgvs"), "HGVS")
    )


def vrs_location_json(accession: Column, start: Column, end: Column) -> Column:
    """The canonical JSON text of a sequence location, with the spacing of Python's json module."""
    return F.format_string('{"type": "SequenceLocation", "sequenceReference": {"type": "SequenceReference", "refgetAccession": "%s"}, "start": %d, "end": %d}', accession, start, end)


def primary_key(chromosome: Column, position: Column, ref: Column, alt: Column, accession: Column) -> Column:
    """SNV, MNV and short variants by their place; structural ones and those of many bases by a digest of their location."""
    kind = variant_class(ref, alt)
    number = F.upper(F.replace(chromosome, F.lit("chr"), F.lit("")))
    digest = F.upper(F.substring(F.sha2(vrs_location_json(accession, position - 1, span_end(position, ref, alt)), 512), 1, 8))
    plain = F.concat_ws(":", F.replace(chromosome, F.lit("chr"), F.lit("")), position.cast("string"), ref, alt)
    long = F.length(ref) + F.length(alt) > MOST_BASES_IN_ID
    structural = F.concat(kind, F.lit("_CHR"), number, F.lit("_"), digest)
    return F.when(kind.isin("SNV", "MNV"), plain).when(kind.startswith("SHORT_") & ~long, plain).when(kind.startswith("SHORT_"), F.concat_ws(":", F.replace(chromosome, F.lit("chr"), F.lit("")), position.cast("string"), digest)).otherwise(structural)
