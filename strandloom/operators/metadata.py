"""Rules for the fields of track-metadata templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Template keys that have another name in records.
RENAMED = {
    "antibody": "antibody_target",
    "downloaded_date": "download_date",
    "processed_file_md5": "md5sum",
    "raw_file_md5": "raw_file_md5sum",
    "technical_replicate": "technical_replicates",
}


def clean_key(name: str) -> str:
    """Snake case without `#`, `(s)` as s; some keys are renamed."""
    plain = name.strip().replace("(s)", "s").replace("#", "")
    key = re.sub(r"[\s]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", plain)).lower()
    return RENAMED.get(key, re.sub(r"^date_added_to_(\w+)$", r"\1_release_date", key))


def clean_keys(rows: DataFrame) -> DataFrame:
    """A template's rows under clean column names."""
    return rows.toDF(*map(clean_key, rows.columns))


def name_and_description(track_name: Column, file_url: Column) -> Column:
    """name (up to a note on peaks or bed files in brackets) and description of a track; from the file's name where there is none."""
    of_file = F.replace(F.replace(F.substring_index(file_url, "/", -1), F.lit(".bed.gz"), F.lit("")), F.lit("_"), F.lit(" "))
    name = F.get(F.split(track_name, r"\s[(\[][^()\[\]]*?eak\)\s|\s\(bed[^()\[\]]*[)\]]\s"), F.lit(0))
    return F.struct(F.coalesce(name, of_file).alias("name"), F.coalesce(track_name, of_file).alias("description"))


def biosample(cell_type: Column, term_id: Column, kind: Column, tissue: Column, system: Column, life_stage: Column, file_name: Column, namespace: str = "track") -> Column:
    """Biosample characteristics of a template row; null without a cell type. A number is no cell type: the file's name up to its first full stop stands for it. Terms without an id get one from their name in a namespace."""
    term = F.when(cell_type.try_cast("double").isNotNull(), F.replace(F.substring_index(F.coalesce(F.try_url_decode(file_name), file_name), ".", 1), F.lit(":"), F.lit(" - "))).otherwise(cell_type)
    named = lambda t, curie: F.struct(t.alias("term"), curie.alias("curie"))
    return F.when(
        cell_type.isNotNull(),
        F.struct(
            F.array(named(term, F.coalesce(term_id, F.concat(F.lit(f"#{namespace}-biosample:"), term)))).alias("biosample"),
            F.when(tissue.isNotNull(), F.array(named(tissue, F.concat(F.lit(f"#{namespace}-tissue:"), tissue)))).alias("tissue"),
            F.when(system.isNotNull(), F.array(system)).alias("system"),
            F.when(life_stage.isNotNull(), named(life_stage, F.concat(F.lit(f"{namespace}-lifestage:"), life_stage))).alias("life_stage"),
            F.when(kind.isNotNull(), F.array(biosample_type(kind))).alias("biosample_type"),
        ),
    )


def feature_type(assay: Column, analysis: Column, output_type: Column, classification: Column, description: Column) -> Column:
    """What a track's features are: by its assay, else its analysis, its classification, its output type."""
    out, cls = F.lower(output_type), F.lower(classification)
    by_assay = (
        F.when(assay.contains("QTL"), assay)
        .when(assay.contains("TF"), "transcription factor binding site")
        .when(assay.contains("Histone"), "histone modification")
        .when(assay.isin("Small RNA-seq", "short total RNA-seq"), "small non-coding RNA")
        .when(assay.isin("FAIRE-seq", "DNase-seq", "ATAC-seq"), "chromatin accessibility")
        .when(assay == "PRO-seq", "enhancer")
        .when(assay.isin("eCLIP", "iCLIP", "RIP-seq"), "protein-RNA crosslink or binding sites")
    )
    noted = F.nullif(F.regexp_extract(description, "All (.+) annotation", 1), F.lit(""))
    by_analysis = F.when((analysis == "annotation") & out.contains("gene"), "gene").when((analysis == "annotation") & out.contains("variant"), "variant").when(analysis == "annotation", noted).when(analysis.contains("QTL"), analysis)
    chip = cls.contains("chip-seq") | cls.contains("chia-pet")
    by_class = (
        F.when(cls.contains("histone-mark"), "histone modification")
        .when(chip & cls.contains("ctcfl"), "CTCFL-binding site")
        .when(chip & cls.contains("ctcf"), "CTCF-binding site")
        .when(chip & cls.startswith("tf "), "transcription factor binding site")
        .when(chip & cls.contains("chromhmm"), "enhancer")
        .when(cls == "rna-pet clusters", "RNA-PET cluster")
    )
    state = F.split(output_type, " at ")
    by_output = (
        F.when(out.contains("enhancer"), "enhancer")
        .when(output_type.contains("methylation state"), F.concat_ws(" ", F.get(state, F.lit(1)), F.get(state, F.lit(0))))
        .when(out.contains("microrna target"), "microRNA target")
        .when(output_type.contains("microRNA"), "microRNA")
        .when(output_type.contains("exon"), "exon")
        .when(output_type.contains("transcription start sites") | output_type.contains("TSS"), "transcription start site")
        .when(output_type.contains("transcribed fragments"), "transcribed fragment")
        .when(output_type.isin("clusters", "ChromHMM", "Genomic Partition"), F.lit(None))
        .when(output_type.startswith("Chromatin"), out)
        .otherwise(output_type)
    )
    return F.coalesce(by_assay, by_analysis, by_class, by_output)


def without_repeated_type(text: Column, kind: Column) -> Column:
    """A QTL track's text without its feature type said twice in a row."""
    return F.when(kind.contains("QTL"), F.replace(text, F.concat_ws(" ", kind, kind), kind)).otherwise(text)


def clean_value(text: Column) -> Column:
    """Null for the templates' words for nothing; without a leading `Not applicable;`; percent codes decoded."""
    t = F.trim(text)
    t = F.trim(F.regexp_replace(t, "^Not applicable;", ""))
    return F.when(F.lower(t).isin("", "null", "na", "none", ".", "not applicable", "unknown"), F.lit(None)).otherwise(F.when(t.contains("%"), F.coalesce(F.try_url_decode(t), t)).otherwise(t))


def genome_build(text: Column) -> Column:
    return F.when(text.contains("hg38"), "GRCh38").otherwise("GRCh37")


def assay_and_analysis(assay: Column, classification: Column) -> Column:
    """assay and analysis of the templates' one field. The words are fixed values of the templates."""
    a = F.replace(assay, F.lit("-Seq"), F.lit("-seq"))
    chrom, note, qtl, dnase = a.contains("ChromHMM"), F.lower(a) == "annotation", a.isin("eQTL", "sQTL"), a.contains("DNase")
    by_class = F.when(classification == "ChIP-seq consolidated ChromHMM", "ChromHMM")
    return F.struct(
        F.when(chrom, "ChIP-seq").when(note | qtl, F.lit(None)).when(dnase, "DNase-seq").otherwise(a).alias("assay"),
        F.when(chrom, a).when(note, "annotation").when(qtl, a).otherwise(by_class).alias("analysis"),
    )


def data_category(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low == "called peaks expression", "called peaks").when(low == "qtl", "QTL").otherwise(low)


def source_and_version(text: Column) -> Column:
    """name and version around the first underscore."""
    return F.struct(F.substring_index(text, "_", 1).alias("source"), F.when(F.instr(text, "_") > 0, F.substr(text, F.instr(text, "_") + 1)).alias("version"))


def format_and_schema(text: Column) -> Column:
    parts = F.split(text, " ")
    first, n = F.get(parts, F.lit(0)), F.size(parts)
    schema = F.when((n == 1) & first.contains("bed"), first).when(n == 2, F.get(parts, F.lit(1))).when(n > 2, F.concat_ws("|", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))
    return F.struct(F.when((n == 1) & first.contains("bed"), "bed").otherwise(first).alias("format"), schema.alias("schema"))


def plain_url(text: Column) -> Column:
    """The address behind `wget`."""
    return F.when(text.contains("wget"), F.split_part(text, F.lit(" "), F.lit(2))).otherwise(text)


def internal_url(text: Column, base: str, marker: str) -> Column:
    """Everything up to the marker folder replaced by a base address."""
    return F.regexp_replace(plain_url(text), rf"^.*?\/{marker}", base)


def is_lifted(build: Column, source: Column) -> Column:
    return F.coalesce(build.contains("lifted"), F.lit(False)) | F.coalesce(source.contains("lifted"), F.lit(False))


def captured(text: Column, pattern: str) -> Column:
    """The first group, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def biosample_type(text: Column) -> Column:
    """The type of a biosample. The words are fixed values of the templates and of the vocabulary."""
    low = F.lower(text)
    return (
        F.when(low == "embryonic stem cell derived", "ESC cell line")
        .when(low == "primary tissue", "tissue")
        .when(low == "in vitro differentiated cells", "experimentally modified cell")
        .when((low == "induced pluripotent stem cell line") | low.contains("ipsc"), "iPSC cell line")
        .when(low.isin("immortalized cell line", "fractionation", "timecourse"), "cell line")
        .when(low == "cell type", "cell")
        .otherwise(low)
    )


def shard_url(text: Column) -> Column:
    """An address with its chromosome as a placeholder."""
    return F.regexp_replace(text, r"chr(\d{1,2}|[XYM]|MT)", r"\$CHR")


def shard_key(name: Column) -> Column:
    """A key for all shards of a track: the name without its chromosome, digested."""
    return F.concat(F.lit("SHARD_GROUP_"), F.upper(F.substring(F.sha2(F.regexp_replace(name, r"chr(\d{1,2}|[XYM]|MT)", "_"), 512), 1, 6)))


def browser_config(schema: Column, url: Column) -> Column:
    """What a genome browser needs to show a track: format and type of `format|type`, and the index address."""
    part = lambda k: F.nullif(F.split_part(schema, F.lit("|"), F.lit(k)), F.lit(""))
    kind = F.coalesce(part(2), F.lit("annotation"))
    return F.struct(part(1).alias("format"), kind.alias("type"), url.alias("url"), F.concat(url, F.lit(".tbi")).alias("index_url"), (kind == "qtl").alias("autoscale"))


def track_records(rows: DataFrame, base: str, marker: str, namespace: str = "track") -> DataFrame:
    """Records from the rows of a template, whose columns are texts under their own names: keys and values cleaned, names, builds, biosamples, design, provenance and files in structs. A column that the template lacks is null."""
    rows = clean_keys(rows)
    rows = rows.select(*(clean_value(F.col(c)).alias(c) for c in rows.columns))
    c = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    named = name_and_description(c("track_name"), internal_url(c("processed_file_download_url"), base, marker))
    design, source, file = assay_and_analysis(c("assay"), c("classification")), source_and_version(c("data_source")), format_and_schema(c("file_format"))
    kind = feature_type(design["assay"], design["analysis"], c("output_type"), c("classification"), c("track_description"))
    record = rows.select(
        c("identifier").alias("track_id"),
        without_repeated_type(named["name"], kind).alias("name"),
        without_repeated_type(named["description"], kind).alias("description"),
        F.when(c("genome_build").isNotNull(), genome_build(c("genome_build"))).alias("genome_build"),
        kind.alias("feature_type"),
        F.coalesce(c("track_type") == "downloadOnly", F.lit(False)).alias("is_download_only"),
        biosample(c("cell_type"), c("biosamples_term_id"), c("biosample_type"), c("tissue_category"), c("system_category"), c("life_stage"), c("file_name"), namespace).alias("biosample_characteristics"),
        F.struct(design["assay"].alias("assay"), design["analysis"].alias("analysis"), c("antibody_target").alias("antibody_target"), data_category(c("data_category")).alias("data_category"), c("output_type").alias("output_type")).alias("experimental_design"),
        F.struct(source["source"].alias("data_source"), source["version"].alias("data_source_version"), c("download_date").alias("download_date")).alias("provenance"),
        F.struct(c("file_name").alias("file_name"), internal_url(c("processed_file_download_url"), base, marker).alias("url"), c("md5sum").alias("md5sum"), file["format"].alias("file_format"), file["schema"].alias("file_schema"), c("file_size").try_cast("long").alias("file_size")).alias("file_properties"),
    )
    return record.where("track_id IS NOT NULL")
