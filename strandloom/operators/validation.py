"""Row validation against a JSON schema, compiled to column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.patterns import PATTERNS

FORMATS = {"pubmed_id": PATTERNS["pubmed_id"], "doi": PATTERNS["doi"], "md5sum": PATTERNS["md5sum"], "file_size": PATTERNS["file_size"], "info_string": r"^[^\s=]+=[^=;]+(;[^\s=]+=[^=;]+)*$"}


def format_ok(column: Column, name: str) -> Column:
    """Null passes."""
    return column.isNull() | F.rlike(column.cast("string"), F.lit(FORMATS[name]))


def _values(rule: dict) -> list:
    if "enum" in rule:
        return rule["enum"]
    return [v for part in rule.get("oneOf", []) for v in (part.get("enum") or ([part["const"]] if "const" in part else []))]


def _resolved(rule: dict, root: dict) -> dict:
    """A rule with its reference into the schema's own definitions looked up."""
    while "$ref" in rule:
        at = root
        for part in rule["$ref"].removeprefix("#/").split("/"):
            at = at[part]
        rule = {**at, **{k: v for k, v in rule.items() if k != "$ref"}}
    return rule


def holds(rule: dict, column: Column, case_insensitive: bool = True) -> Column:
    """Whether a value that is there meets the enum, const, pattern and not of a rule."""
    text, out = column.cast("string"), F.lit(True)
    low = (lambda c: F.lower(c)) if case_insensitive else (lambda c: c)
    if allowed := ([rule["const"]] if "const" in rule else _values(rule)):
        out &= low(text).isin([str(v).lower() if case_insensitive else str(v) for v in allowed if v is not None])
    if "pattern" in rule:
        out &= F.rlike(text, F.lit(rule["pattern"]))
    if "not" in rule:
        out &= ~holds(rule["not"], column, case_insensitive)
    return out


def _conditional(part: dict, root: dict, columns: list[str], case_insensitive: bool) -> Column | None:
    """The messages of an if-then-else rule. A condition holds where all fields that it names are filled and meet it."""
    rules = {n: _resolved(r, root) for n, r in part["if"].get("properties", {}).items()}
    if not set(rules) <= set(columns):
        return None
    met = F.lit(True)
    for name, rule in rules.items():
        met &= F.col(name).isNotNull() & F.coalesce(holds(rule, F.col(name), case_insensitive), F.lit(False))
    for name in part["if"].get("required", []):
        met &= F.col(name).isNotNull() if name in columns else F.lit(False)
    inner = lambda k: errors({**part.get(k, {}), "definitions": root.get("definitions", {})}, columns, case_insensitive)
    return F.when(met, inner("then")).otherwise(inner("else"))


def errors(schema: dict | str, columns: list[str], case_insensitive: bool = True) -> Column:
    """The messages of a row, an array. Rules of fields, references to definitions, and conditions (if, then, else; alone or in allOf)."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    found = []
    message = lambda bad, *parts: F.when(bad, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    for name in schema.get("required", []):
        if name in columns:
            found.append(message(F.col(name).isNull() | (F.col(name).cast("string") == ""), f"required field `{name}` is empty"))
    for name, rule in schema.get("properties", {}).items():
        if name not in columns:
            continue
        c = F.col(name)
        text = c.cast("string")
        rule = _resolved(rule, schema)
        if allowed := [v for v in _values(rule) if v is not None]:
            known = F.lower(text).isin([str(v).lower() for v in allowed]) if case_insensitive else text.isin([str(v) for v in allowed])
            found.append(message(c.isNotNull() & ~known, f"field `{name}` has the value ", text, f"; allowed: {', '.join(map(str, allowed))}"))
        if "pattern" in rule:
            found.append(message(c.isNotNull() & ~F.rlike(text, F.lit(rule["pattern"])), f"field `{name}` has the value ", text, f", which is not {rule['pattern']}"))
        if rule.get("format") in FORMATS:
            found.append(message(~format_ok(c, rule["format"]), f"field `{name}` has the value ", text, f", which is no {rule['format']}"))
        if "minimum" in rule:
            found.append(message(text.try_cast("double") < rule["minimum"], f"field `{name}` is below {rule['minimum']}"))
        if "maximum" in rule:
            found.append(message(text.try_cast("double") > rule["maximum"], f"field `{name}` is above {rule['maximum']}"))
        kinds = rule.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if "minLength" in rule:
            short = F.length(text) < rule["minLength"]
            found.append(message(short | (c.isNull() if "null" not in kinds else F.lit(False)), f"field `{name}` is shorter than {rule['minLength']}"))
        if kinds == ["null"]:
            found.append(message(c.isNotNull(), f"field `{name}` must be empty, not ", text))
        if kinds and "string" not in kinds and {"number", "integer"} & set(kinds):
            found.append(message(c.isNotNull() & text.try_cast("double").isNull(), f"field `{name}` has the value ", text, ", which is no number"))
    lists = [F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")]
    parts = [p for p in [schema, *schema.get("allOf", [])] if "if" in p]
    lists += [c for p in parts if (c := _conditional(p, schema, columns, case_insensitive)) is not None]
    return F.concat(*lists)


def file_errors(schema: dict, columns: list[str]) -> list[str]:
    """What is wrong with the file as a whole, once: columns that are missing, or not allowed."""
    out = [f"required column `{c}` is missing" for c in schema.get("required", []) if c not in columns]
    if schema.get("additionalProperties") is False:
        out += [f"column `{c}` is not allowed" for c in columns if c not in schema.get("properties", {})]
    return out


def validate(rows: DataFrame, schema: dict, line: str) -> DataFrame:
    """line and message of every error of every row. line: a column with the row's number."""
    names = [c for c in rows.columns if c != line]
    return rows.select(line, F.explode(errors(schema, names)).alias("message"))


def canonical(column: Column, allowed: list[str]) -> Column:
    """Values in the case of the vocabulary."""
    table = F.create_map(*(x for v in allowed for x in (F.lit(v.lower()), F.lit(v))))
    return F.coalesce(F.try_element_at(table, F.lower(column)), column)


def cross_check(manifest: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Sample ids that only one side has: an error in the manifest, a warning in the samples."""
    used, known = manifest.select(key).where(F.col(key).isNotNull()).distinct(), samples.select(key).distinct()
    bad = used.join(known, key, "left_anti").select(key, F.lit("error").alias("level"), F.lit("unknown sample").alias("message"))
    idle = known.join(used, key, "left_anti").select(key, F.lit("warning").alias("level"), F.lit("no file for sample").alias("message"))
    return bad.unionByName(idle)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def transposed(rows: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """A file of properties as one map."""
    return rows.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("properties"))
