"""Nested schemas against a plain walk over JSON values."""

from __future__ import annotations

import random
import re

import pytest

from strandloom.operators.nested_validation import validate_nested

TYPE = "sex: string, age: int, samples: array<struct<id: string, tissue: string, tags: array<string>>>, consent: struct<given: boolean, by: string>, score: string"
SCHEMA = {
    "type": "object",
    "required": ["sex", "samples"],
    "definitions": {"sample": {"type": "object", "required": ["id"], "properties": {"id": {"pattern": "^S[0-9]+$"}, "tissue": {"oneOf": [{"enum": ["blood", "skin"]}, {"enum": ["brain"], "type": "string"}]}, "tags": {"uniqueItems": True, "items": {"type": "string", "maxLength": 3}}}}},
    "properties": {
        "sex": {"enum": ["F", "M"]},
        "age": {"type": "integer", "minimum": 0, "maximum": 120, "not": {"const": 99}},
        "score": {"anyOf": [{"type": "number", "minimum": 5}, {"const": "NA"}]},
        "samples": {"minItems": 1, "maxItems": 3, "items": {"$ref": "#/definitions/sample"}, "contains": {"properties": {"tissue": {"const": "blood"}}, "required": ["tissue"]}},
        "consent": {"additionalProperties": False, "properties": {"given": {"type": "boolean"}}},
    },
    "dependentRequired": {"age": ["score"]},
    "allOf": [{"if": {"properties": {"sex": {"const": "F"}}, "required": ["sex"]}, "then": {"required": ["age"]}, "else": {"properties": {"age": {"maximum": 80}}}}],
}


def plain(rule, v, path="$", root=SCHEMA):
    """Paths of what is wrong with a JSON value."""
    if rule is True or v is None:
        return []
    if rule is False:
        return [path]
    if "$ref" in rule:
        rule = root["definitions"][rule["$ref"].rsplit("/", 1)[1]]
    out = []
    fits = lambda r, x=v: not plain(r, x, path)
    if "type" in rule:
        number = lambda x: isinstance(x, int) or (isinstance(x, str) and re.fullmatch(r"-?\d+(\.\d+)?", x))
        ok = {"object": lambda: isinstance(v, dict), "integer": lambda: isinstance(v, int), "number": lambda: bool(number(v)), "string": lambda: isinstance(v, str), "boolean": lambda: isinstance(v, bool)}[rule["type"]]()
        out += [] if ok else [path]
    if "enum" in rule and v not in rule["enum"]:
        out.append(path)
    if "const" in rule and v != rule["const"]:
        out.append(path)
    if isinstance(v, str):
        out += [path] * ("pattern" in rule and not re.search(rule["pattern"], v)) + [path] * (len(v) > rule.get("maxLength", 99))
    try:
        out += [path] * (float(v) < rule.get("minimum", float("-inf"))) + [path] * (float(v) > rule.get("maximum", float("inf")))
    except (TypeError, ValueError):
        pass
    if isinstance(v, dict):
        out += [path for name in rule.get("required", []) if v.get(name) is None]
        out += [path for name, needs in rule.get("dependentRequired", {}).items() for n in needs if v.get(name) is not None and v.get(n) is None]
        for name, x in v.items():
            out += plain(rule.get("properties", {}).get(name, rule.get("additionalProperties", True)), x, f"{path}.{name}", root)
    if isinstance(v, list):
        for i, x in enumerate(v):
            out += [f"{path}[{i}]"] if x is None and "items" in rule else plain(rule.get("items", True), x, f"{path}[{i}]", root)
        out += [path] * (len(v) < rule.get("minItems", 0)) + [path] * (len(v) > rule.get("maxItems", 99))
        out += [path] * bool(rule.get("uniqueItems") and len({str(x) for x in v}) < len(v))
        out += [path] * bool("contains" in rule and not any(x is not None and not plain(rule["contains"], x) for x in v))
    for sub in rule.get("allOf", []):
        out += plain(sub, v, path, root)
    out += [path] * bool("anyOf" in rule and not any(map(fits, rule["anyOf"]))) + [path] * bool("oneOf" in rule and sum(map(fits, rule["oneOf"])) != 1) + [path] * bool("not" in rule and fits(rule["not"]))
    if "if" in rule:
        out += plain(rule.get("then" if fits(rule["if"]) else "else", True), v, path, root)
    return out


def random_row(rnd):
    pick = lambda *v: rnd.choice(v)
    sample = lambda: pick(None, *[{"id": pick("S1", "S22", "x", None), "tissue": pick("blood", "brain", "skin", "bone", None), "tags": pick(None, [], ["a", "b"], ["a", "a"], ["long", None, "b"])}] * 9)
    return {"sex": pick("F", "M", "x", None), "age": pick(None, 5, 99, 100, 130, -1), "samples": pick(None, [], *[[sample() for _ in range(pick(1, 2, 4))]] * 6), "consent": pick(None, {"given": True, "by": None}, {"given": None, "by": "me"}), "score": pick(None, "7", "3", "NA", "x")}


def test_against_a_plain_walk(spark):
    rnd = random.Random(7)
    fine = {"sex": "F", "age": 5, "samples": [{"id": "S1", "tissue": "blood", "tags": ["a"]}], "consent": {"given": True, "by": None}, "score": "7"}
    rows = [random_row(rnd) for _ in range(400)] + [fine, {**fine, "age": None}, {**fine, "sex": "M", "age": None, "consent": None, "score": None}]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"id int, doc struct<{TYPE}>")
    found = {}
    for r in validate_nested(frame, SCHEMA, "id", "doc").collect():
        found.setdefault(r["id"], []).append(r["message"].split(": ", 1)[0])
    for k, row in enumerate(rows):
        assert sorted(found.get(k, [])) == sorted(plain(SCHEMA, row)), (row, found.get(k))
    assert sum(not plain(SCHEMA, r) for r in rows) >= 2


def test_messages_and_references(spark):
    frame = spark.createDataFrame([(1, [3, 3], {"a": "x"})], "id int, n array<int>, m map<string, string>")
    schema = {"properties": {"n": {"uniqueItems": True, "items": {"maximum": 2}}, "m": {"additionalProperties": {"pattern": "^y"}}}}
    assert {r["message"] for r in validate_nested(frame, schema, "id").collect()} == {"$.n[0]: above 2", "$.n[1]: above 2", "$.n: items come twice", "$.m.a: not like ^y"}
    loop = {"definitions": {"a": {"$ref": "#/definitions/a"}}, "properties": {"id": {"$ref": "#/definitions/a"}}}
    with pytest.raises(ValueError, match="itself"):
        validate_nested(frame, loop, "id")
