"""Ontologies with restrictions and deprecated terms, and patterns against walking by hand."""

from __future__ import annotations

import random

import pytest

from strandloom.operators.graph import Step, expand_nearest, paths
from strandloom.sources import rdf

OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s" xmlns:obo="b" xmlns:oboInOwl="i">
<owl:Class rdf:about="http://purl.obolibrary.org/obo/SO_0000016"><rdfs:label xml:lang="en">motif</rdfs:label>
 <rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/SO_0001660"/>
 <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://purl.obolibrary.org/obo/so#part_of"/><owl:someValuesFrom rdf:resource="http://purl.obolibrary.org/obo/SO_0001669"/></owl:Restriction></rdfs:subClassOf>
 <oboInOwl:hasExactSynonym>b</oboInOwl:hasExactSynonym><oboInOwl:hasExactSynonym>a</oboInOwl:hasExactSynonym></owl:Class>
<owl:Class rdf:about="http://purl.obolibrary.org/obo/SO_1"><rdfs:label>old</rdfs:label><owl:deprecated>true</owl:deprecated><rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/SO_2"/></owl:Class>
<owl:Class rdf:about="http://purl.obolibrary.org/obo/SO_3"><owl:deprecated>true</owl:deprecated></owl:Class>
<owl:Class rdf:about="http://purl.obolibrary.org/obo/SO_4"><owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection"><rdf:Description rdf:about="http://purl.obolibrary.org/obo/SO_5"/>
 <owl:Restriction><owl:onProperty rdf:resource="http://purl.obolibrary.org/obo/RO_7"/><owl:allValuesFrom rdf:resource="http://purl.obolibrary.org/obo/SO_6"/></owl:Restriction></owl:intersectionOf></owl:Class></owl:equivalentClass>
 <obo:RO_0002202 rdf:resource="http://purl.obolibrary.org/obo/SO_0000016"/></owl:Class>
<owl:AnnotationProperty rdf:about="http://www.geneontology.org/formats/oboInOwl#saved-by"/>
<owl:NamedIndividual rdf:about="http://purl.obolibrary.org/obo/SO_8"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#ObjectProperty"/><rdfs:label>both</rdfs:label></owl:NamedIndividual>
<rdf:Description rdf:about="http://purl.obolibrary.org/obo/SO_0000016"><obo:IAO_0000115>said elsewhere</obo:IAO_0000115></rdf:Description>
<rdf:Description rdf:about="http://purl.obolibrary.org/obo/SO_9"><rdfs:label>no type</rdfs:label></rdf:Description>
</rdf:RDF>"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    where = tmp_path_factory.mktemp("owl") / "a.owl"
    where.write_text(OWL)
    return str(where)


def test_entities(spark, path):
    found = {r["curie"]: r for r in rdf.read_entities(spark, path).collect()}
    assert {k: (r["entity_type"], r["term"]) for k, r in found.items()} == {"SO:0000016": ("Class", "motif"), "SO:4": ("Class", "SO:4"), "oboInOwl#saved-by": ("AnnotationProperty", "saved-by"), "SO:8": ("ObjectProperty", "both")}
    assert found["SO:0000016"]["definition"] == "said elsewhere" and found["SO:0000016"]["synonyms"] == ["a", "b"] and found["SO:8"]["synonyms"] is None
    kept = {r["curie"]: r["is_deprecated"] for r in rdf.read_entities(spark, path, deprecated=True).collect()}
    assert kept["SO:1"] is True and "SO:3" not in kept


def test_triples_and_restrictions(spark, path):
    rows = [tuple(r) for r in rdf.read_triples(spark, path, ("obo:RO_0002202",)).collect()]
    blanks = {s: o for s, p, o, kind in rows if kind == "blank"}
    assert set(blanks) == {"SO:0000016", "SO:4"}
    assert {(s, p, o) for s, p, o, kind in rows if kind == "iri"} == {
        ("SO:0000016", "subClassOf", "SO:0001660"), (blanks["SO:0000016"], "so#part_of", "SO:0001669"), ("SO:4", "equivalentClass", "SO:5"), (blanks["SO:4"], "RO:7", "SO:6"),
        ("SO:4", "RO:0002202", "SO:0000016"), ("SO:8", "type", "owl#ObjectProperty"),
    }
    again = {o for s, p, o, kind in map(tuple, rdf.read_triples(spark, path).collect()) if kind == "blank"}
    assert again == set(blanks.values())
    assert any(s == "SO:1" for s, *_ in map(tuple, rdf.read_triples(spark, path, deprecated=True).collect()))


def walked(edges, starts, steps, allowed):
    """Shortest numbers of hops by (start, node), by sets."""
    now = {(s, s): 0 for s in starts}
    for step in steps:
        reached = dict(now) if step.least == 0 else {}
        layer = now
        for hop in range(1, step.most + 1):
            new = {}
            for (s, n), length in layer.items():
                for a, p, b in edges:
                    a, b = (b, a) if step.backward else (a, b)
                    if a == n and (step.predicates is None or p in step.predicates):
                        new[s, b] = min(new.get((s, b), 99), length + 1)
            layer = {k: v for k, v in new.items() if k not in reached}
            if hop >= step.least:
                reached |= layer
        now = {k: v for k, v in reached.items() if step.where is None or k[1] in allowed}
    return now


def test_patterns_against_walking(spark):
    rnd = random.Random(4)
    edges = [(f"n{rnd.randrange(25)}", rnd.choice("pqr"), f"n{rnd.randrange(25)}") for _ in range(60)]
    frame = spark.createDataFrame([*edges, edges[0], ("n1", None, "n2"), (None, "p", "n3")], "subject string, predicate string, object string")
    nodes = spark.createDataFrame([(f"n{k}", k) for k in range(25)], "node string, k int")
    starts = spark.createDataFrame([("n1",), ("n2",), ("n2",), (None,), ("nowhere",)], "node string")
    allowed = {f"n{k}" for k in range(0, 25, 2)}
    for steps in ([Step(("p",))], [Step(None, least=0, most=3)], [Step(("p", "q"), backward=True, least=2, most=3), Step(("r",), most=2)], [Step(None, most=2, where=nodes["k"] % 2 == 0), Step(("q",), backward=True)]):
        found = paths(frame, starts, steps, nodes).collect()
        want = walked(edges, ["n1", "n2", "nowhere"], steps, allowed)
        assert {(r["start"], r["node"]): len(r["path"]) for r in found} == want
        for r in found:
            at = r["start"]
            for hop in r["path"]:
                back, p = hop["predicate"].startswith("^"), hop["predicate"].lstrip("^")
                assert ((hop["node"], p, at) if back else (at, p, hop["node"])) in edges
                at = hop["node"]
            assert at == r["node"]
    with pytest.raises(ValueError, match="3 to 2"):
        paths(frame, starts, [Step(None, least=3, most=2)])


def test_nearest_lead_on(spark):
    edges = spark.createDataFrame([("a", "x", "b"), ("c", "x", "b"), ("b", "x", "d")], "subject string, predicate string, object string")
    near = spark.createDataFrame([("a", 0.9), ("c", 0.95), ("d", 0.1)], "id string, similarity double")
    found = {r["node"]: (r["hops"], r["similarity"], r["start"]) for r in expand_nearest(near, edges, [Step(None, most=2)]).collect()}
    assert found == {"a": (0, 0.9, "a"), "c": (0, 0.95, "c"), "b": (1, 0.95, "c"), "d": (2, 0.95, "c")}
