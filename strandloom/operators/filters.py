"""The filter language of track searches: `field op value and field op value ...`.

Operators are eq, neq, like, not like, gt, lt, gte and lte; values are words of
letters joined by single blanks, or numbers after a comparison. Text equality is
case-insensitive and takes `%` and `_` as wildcards; like looks inside. A null
field drops the row under every operator."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLAUSE = re.compile(r"^\s*([A-Za-z_]+)\s+(not like|eq|neq|like|gte|lte|gt|lt)\s+(.+?)\s*$")
_WORDS = re.compile(r"^[A-Za-z]+( [A-Za-z]+)*$")
_NUMBER = re.compile(r"^-?\d+(\.\d+)?$")
_OPERATOR = r"(?:not like|eq|neq|like|gte|lte|gt|lt)"


@dataclass(frozen=True)
class Triple:
    field: str
    op: str
    value: str

    def column(self, on: Column) -> Column:
        value = float(self.value) if _NUMBER.match(self.value) else self.value
        compare = {"gt": on > value, "lt": on < value, "gte": on >= value, "lte": on <= value}
        if self.op in compare:
            return compare[self.op]
        if isinstance(value, float):
            return on == value if self.op == "eq" else on != value
        if self.op in ("like", "not like"):
            found = F.ilike(on, F.lit(f"%{value}%"))
            return found if self.op == "like" else ~found
        found = F.ilike(on, F.lit(value))
        return found if self.op == "eq" else ~found


def parse(text: str) -> list[Triple]:
    """Triples of a filter text; ValueError says what is wrong. `and` inside a value is part of it unless a clause follows."""
    parts = re.split(rf"\s+and\s+(?=[A-Za-z_]+\s+{_OPERATOR}\s)", text.strip())
    out = []
    for part in parts:
        m = _CLAUSE.match(part)
        if not m:
            raise ValueError(f"no filter: {part!r}; expected `field op value`")
        field, op, value = m.groups()
        if not (_NUMBER.match(value) if op in ("gt", "lt", "gte", "lte") else _WORDS.match(value)):
            raise ValueError(f"no value for {op}: {value!r}")
        out.append(Triple(field, op, value))
    return out


def condition(text: str, fields: dict[str, str]) -> Column:
    """A filter text as one condition. fields: the columns (or struct fields) of the names it may use."""
    triples = parse(text)
    unknown = sorted({t.field for t in triples} - set(fields))
    if unknown:
        raise ValueError(f"unknown fields {unknown}; allowed: {sorted(fields)}")
    out = F.lit(True)
    for t in triples:
        on = fields[t.field]
        if t.field == CELL:
            out &= biosample_condition(t, on, fields["biosample_type"])
        elif t.field == TISSUE and t.op in WIDER:
            out &= Triple(t.field, WIDER[t.op], t.value).column(F.col(on))
        else:
            out &= t.column(F.col(on))
    return out


#: Fields with a meaning of their own: a cell is looked for among the terms of biosamples that are cells, a tissue always by part of its name.
CELL, TISSUE = "cell", "tissue"
WIDER = {"eq": "like", "neq": "not like"}


def biosample_condition(t: Triple, biosamples: str, kind: str) -> Column:
    """Biosamples of a cell type, one of which has (for neq and not like: none has) the value in its term."""
    found = biosample_is(biosamples, t.value)
    return F.ilike(F.col(kind), F.lit("%cell%")) & (~found if t.op in ("neq", "not like") else found)


#: Fields of track metadata and where they are kept.
TRACK_FIELDS = {
    "data_source": "provenance.data_source",
    "assay": "experimental_design.assay",
    "feature_type": "feature_type",
    "antibody_target": "experimental_design.antibody_target",
    "data_category": "experimental_design.data_category",
    "biosample_type": "biosample_characteristics.biosample_type",
    "tissue": "biosample_characteristics.tissue",
    "cell": "biosample_characteristics.biosample",
}


def keyword(column: str, pattern: str) -> Column:
    """A case-insensitive regular expression in searchable text."""
    return F.rlike(F.col(column), F.lit(f"(?i){pattern}"))


def biosample_is(column: str, word: str) -> Column:
    """Any biosample whose term holds the word."""
    return F.exists(column, lambda b: F.ilike(b["term"], F.lit(f"%{word}%")))


def neg_log10(p: str | float) -> float:
    """-log10 of a p-value; exponents past the range of doubles count by themselves."""
    import math

    m = re.match(r"^[\d.]+e-(\d+)$", str(p))
    if m and int(m.group(1)) > 300:
        return float(m.group(1))
    return -math.log10(float(p))


def pvalue_at_most(column: Column, p: str | float) -> Column:
    """neg_log10 values that reach p, which lies in (0, 0.001]."""
    if not (neg_log10(p) >= 3):
        raise ValueError("p must be above 0 and at most 1e-3")
    return column >= neg_log10(p)


TRAITS = {"AD": ("AD",), "BIOMARKER": ("Biomarker",), "ADRD": ("ADRD",), "OTHER": ("Other",), "ALL_AD": ("AD", "Biomarker", "ADRD"), "ALL": ("AD", "Biomarker", "ADRD", "Other")}
SOURCES = {"GWAS": ("summary statistics",), "CURATED": ("curated",), "ALL": ("summary statistics", "curated")}


def trait_is(column: Column, trait: str) -> Column:
    return column.isin(*TRAITS[trait.upper()])


def source_is(column: Column, source: str) -> Column:
    return column.isin(*SOURCES[source.upper()])


def database_ref(name: Column, key: Column, wanted: str) -> Column:
    """A database by part of its name, or by its key."""
    return F.ilike(name, F.lit(f"%{wanted}%")) | (key == wanted.upper())


def impacts_gene(consequence: str, gene: str) -> Column:
    """The gene of a consequence struct by id or symbol; null is no match."""
    return F.coalesce((F.col(f"{consequence}.gene.id") == gene) | (F.col(f"{consequence}.gene.symbol") == gene), F.lit(False))


def only_live(tracks: DataFrame, live: DataFrame, skip_sources: list[str], skip_prefixes: list[str]) -> DataFrame:
    """Tracks on the live list, of sources that are not left out."""
    out = tracks.join(live.select("track_id").distinct(), "track_id", "left_semi").where(~F.col("data_source").isin(skip_sources))
    for prefix in skip_prefixes:
        out = out.where(~F.startswith(F.col("data_source"), F.lit(prefix)))
    return out
