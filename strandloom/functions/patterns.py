"""Identifier patterns (fixed values), for rlike and regexp_extract."""

CHROMOSOME = r"(?:[1-9]|1[0-9]|2[0-2]|X|Y|M|MT)"

PATTERNS = {
    "pubmed_id": r"^([0-9]{8}|PMID:[0-9]{8})$",
    "md5sum": r"^[a-fA-F0-9]{32}$",
    "doi": r"""(10[.][0-9]{4,}(?:[.][0-9]+)*\/(?:(?!["&\'<>])\S)+)$""",
    "file_size": r"^[.0-9]+\s?(K|M|G)$",
    "key_value_pair": r"^[^\s=]+=[^=;]+$",
    "shard": r"chr(\d{1,2}|[XYM]|MT)",
    "gene": r"^(?:[A-Za-z][A-Za-z0-9_.-]*(@)?|\d{5})$",
    "positional_variant": r"^.+:\d+:[ACGT]+:[ACGT]+$",
    "normalized_positional_variant": r"^.+:\d+:[ACGT-]+:[ACGT-]+$",
    "ref_snp": r"^rs\d+$",
    "structural_variant": r"^(INDEL|DEL|INS|DUP|INV|CNV|TRA)_CHR(\d{1,2}|[XYM]|MT)_([A-Z]|\d){8}$",
    "spdi": r"^[^:]+:\d+:[ACGTNacgtn-]+:[ACGTNacgtn-]+$",
    "gnomad": rf"^{CHROMOSOME}-\d+-[ACGTN]+-[ACGTN]+$",
    "hgvs": r"^[\w\d]+(:g\.)?\d+[ACGTNacgtn>_delinsdupinsinv]+$",
    "beacon": rf"^\s*{CHROMOSOME}\s*:\s*\d+\s*[ACGTNacgtn]+\s*>\s*[ACGTNacgtn]+\s*$",
    "genomic_location": rf"^(chr)?{CHROMOSOME}[:\-](\d+)[\-:](\d+)$",
    "ensembl_gene": r"^ENSG\d+$",
    "ensembl_transcript": r"^ENST\d+$",
    "ensembl_exon": r"^ENSE\d+$",
    "ensembl_protein": r"^ENSP\d+$",
    "cytogenic_location": r"^(chr)?(\d{1,2}|X|Y|M|MT)(p|q)(\d{1,2}(\.\d+)?)(-(p|q)?\d{1,2}(\.\d+)?)?$",
    "url": r"^https?://[\w.-]+(?:\.[\w\.-]+)+(?:/[\w\-./?%&=]*)?$",
    "external_database_ref": r"^(.+?)\|([^\s|]+)$",
    "ontology_curie": r"^[A-Za-z][A-Za-z0-9_]+[:_][A-Za-z0-9_]+$",
    "attribution": r"^[A-Z][a-zA-Z'-]+(?: et al\.)? \d{4}$",
}
