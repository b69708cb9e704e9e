"""Ontologies in RDF/XML as entities and triples.

Each kind of element is one distributed read by its tag; whatever says the same of an IRI, in any file or element, comes together by IRI. A restriction has no IRI: it becomes a blank node whose
id is a digest of what it says, so the same restriction of the same subject is one node in every run, and its filler an edge under the property that it restricts.

Elements without an IRI, and IRIs without a known type, are left out. Of several types the first of ENTITY_TYPES counts. Deprecated entities are left out unless they are asked for, then only those without a label are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of entities by priority, their tags, and the annotations that are read.
ENTITY_TYPES = ["Class", "ObjectProperty", "NamedIndividual", "AnnotationProperty"]
OWL = "http://www.w3.org/2002/07/owl#"
TAGS = [*(f"owl:{name}" for name in ENTITY_TYPES), "rdf:Description"]
ANNOTATIONS = {
    "preferred": "obo:IAO_0000111",
    "label": "rdfs:label",
    "comment": "rdfs:comment",
    "definition": "obo:IAO_0000115",
    "other_definition": "skos:definition",
    "synonym": "oboInOwl:hasExactSynonym",
    "curie": "oboInOwl:id",
    "namespace": "oboInOwl:hasOBONamespace",
    "deprecated": "owl:deprecated",
}
#: What can say of a class that it is one of those that have something.
_LINK = "struct<`_rdf:resource`: string>"
_RESTRICTION = f"struct<`owl:onProperty`: {_LINK}, `owl:someValuesFrom`: {_LINK}, `owl:allValuesFrom`: {_LINK}, `owl:hasValue`: {_LINK}>"
_INSIDE = f"struct<`owl:intersectionOf`: struct<`rdf:Description`: array<struct<`_rdf:about`: string>>, `owl:Restriction`: array<{_RESTRICTION}>>>"
_SUPER = f"array<struct<`_rdf:resource`: string, `owl:Restriction`: {_RESTRICTION}, `owl:Class`: {_INSIDE}>>"
RELATIONS = {"subClassOf": "rdfs:subClassOf", "equivalentClass": "owl:equivalentClass"}
TRIPLE = "subject string, predicate string, object string, object_kind string"


def curie(iri: Column) -> Column:
    """The local part of an IRI; PREFIX_number becomes PREFIX:number."""
    local = F.substring_index(iri, "/", -1)
    return F.when(local.contains("#"), F.when(F.substring_index(local, "#", 1).rlike("^$"), F.substring_index(local, "#", -1)).otherwise(local)).otherwise(F.regexp_replace(local, "_", ":"))


def _elements(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """One row for each element about an IRI: its tag and what is in it. properties: tags of further relations."""
    said = ", ".join(f"`{tag}` array<string>" for tag in ANNOTATIONS.values())
    links = ", ".join(f"`{tag}` array<{_LINK}>" for tag in ["rdf:type", *properties])
    supers = ", ".join(f"`{tag}` {_SUPER}" for tag in RELATIONS.values())
    parts = []
    for tag in TAGS:
        rows = spark.read.format("xml").option("rowTag", tag).schema(f"`_rdf:about` string, {said}, {links}, {supers}").load(path)
        parts.append(rows.where("`_rdf:about` IS NOT NULL").select(F.col("`_rdf:about`").alias("iri"), F.lit(tag).alias("tag"), *[F.col(f"`{c}`") for c in rows.columns if c != "_rdf:about"]))
    return reduce(DataFrame.unionByName, parts)


def _types(rows: DataFrame) -> DataFrame:
    """iri and entity_type: the first of all types that are said of it."""
    given = F.array_compact(F.array_append(F.transform(F.coalesce("`rdf:type`", F.array()), lambda x: x["_rdf:resource"]), F.concat(F.lit(OWL), F.substring_index("tag", ":", -1))))
    order = F.array(*[F.lit(OWL + name) for name in ENTITY_TYPES])
    place = F.explode(F.transform(given, lambda t: F.array_position(order, t))).alias("place")
    first = rows.select("iri", place).where("place > 0").groupBy("iri").agg(F.min("place").cast("int").alias("place"))
    return first.select("iri", F.element_at(F.array(*map(F.lit, ENTITY_TYPES)), F.col("place")).alias("entity_type"))


def _terms(rows: DataFrame) -> DataFrame:
    """One row for each IRI with a type: its annotations, the least of several where one is wanted."""
    texts = {name: F.transform(F.coalesce(f"`{tag}`", F.array()), lambda x: F.nullif(F.trim(x), F.lit(""))) for name, tag in ANNOTATIONS.items()}
    gathered = rows.select("iri", *[texts[name].alias(name) for name in ANNOTATIONS])
    least = [F.min(F.array_min(name)).alias(name) for name in ANNOTATIONS if name != "synonym"]
    # What one IRI has is bounded by what was written about it.
    joined = gathered.groupBy("iri").agg(*least, F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("synonym"))))).alias("synonyms"))
    return joined.join(_types(rows), "iri")


def read_entities(spark: SparkSession, path: str, deprecated: bool = False, properties: tuple[str, ...] = ()) -> DataFrame:
    """term_iri, entity_type, curie, term, definition, synonyms, namespace and is_deprecated of the entities of RDF/XML files."""
    rows = _terms(_elements(spark, path, list(properties)))
    name = F.coalesce("curie", curie(F.col("iri")))
    gone = F.coalesce(F.lower("deprecated").isin("true", "1"), F.lit(False))
    term = F.coalesce("preferred", "label", "comment", F.when(name.contains("#"), F.substring_index(name, "#", -1)), F.when(~gone, name))
    synonyms = F.when(F.size("synonyms") > 0, F.col("synonyms"))
    out = rows.select(F.col("iri").alias("term_iri"), "entity_type", name.alias("curie"), term.alias("term"), F.coalesce("definition", "other_definition").alias("definition"), synonyms.alias("synonyms"), "namespace", gone.alias("is_deprecated"))
    return out.where("term IS NOT NULL" if deprecated else "NOT is_deprecated")


def read_triples(spark: SparkSession, path: str, properties: tuple[str, ...] = (), deprecated: bool = False) -> DataFrame:
    """TRIPLE, each once: types, superclasses and equivalents, the relations named by properties (their tags), and restrictions. object_kind is iri or blank.

    A restriction gives (subject, has_restriction, blank) and (blank, its property, its filler)."""
    rows = _elements(spark, path, list(properties))
    known = _types(rows)
    if not deprecated:
        gone = rows.select("iri", F.explode(F.transform(F.coalesce("`owl:deprecated`", F.array()), lambda x: F.lower(F.trim(x)))).alias("d")).where("d IN ('true', '1')").select("iri").distinct()
        known = known.join(gone, "iri", "left_anti")
    triple = lambda s, p, o, kind: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"), F.lit(kind).alias("object_kind"))
    subject = curie(F.col("iri"))
    to = lambda name: lambda x: triple(subject, F.lit(name), curie(x), "iri")
    none = F.array().cast("array<struct<subject: string, predicate: string, object: string, object_kind: string>>")

    def restrictions(found: Column) -> Column:
        """The triples of an array of restrictions."""

        def of(r: Column) -> Column:
            filler = F.coalesce(r["owl:someValuesFrom"]["_rdf:resource"], r["owl:allValuesFrom"]["_rdf:resource"], r["owl:hasValue"]["_rdf:resource"])
            by = curie(r["owl:onProperty"]["_rdf:resource"])
            blank = F.concat(F.lit("_:"), F.substring(F.sha2(F.concat_ws("|", F.col("iri"), F.to_json(r)), 256), 1, 16))
            said = F.array(triple(subject, F.lit("has_restriction"), blank, "blank"), triple(blank, by, curie(filler), "iri"))
            return F.when(r.isNotNull() & by.isNotNull() & filler.isNotNull(), said).otherwise(none)

        return F.flatten(F.transform(F.coalesce(found, F.array()), of))

    out = [F.transform(F.filter(F.transform(F.coalesce("`rdf:type`", F.array()), lambda x: x["_rdf:resource"]), lambda x: x.isNotNull()), lambda x: triple(subject, F.lit("type"), curie(x), "iri"))]
    for name, tag in RELATIONS.items():
        column = F.col(f"`{tag}`")
        inside = F.flatten(F.transform(column, lambda x: F.coalesce(x["owl:Class"]["owl:intersectionOf"]["rdf:Description"], F.array())))
        targets = F.array_compact(F.concat(F.transform(column, lambda x: x["_rdf:resource"]), F.transform(inside, lambda x: x["_rdf:about"])))
        out.append(F.transform(F.coalesce(targets, F.array().cast("array<string>")), to(name)))
        out.append(restrictions(F.transform(column, lambda x: x["owl:Restriction"])))
        out.append(restrictions(F.flatten(F.transform(column, lambda x: F.coalesce(x["owl:Class"]["owl:intersectionOf"]["owl:Restriction"], F.array())))))
    for tag in properties:
        targets = F.array_compact(F.transform(F.col(f"`{tag}`"), lambda x: x["_rdf:resource"]))
        out.append(F.transform(F.coalesce(targets, F.array().cast("array<string>")), to(tag.split(":", 1)[1].replace("_", ":"))))
    return rows.join(known.select("iri"), "iri", "left_semi").select(F.explode(F.concat(*out)).alias("t")).select("t.*").distinct()
