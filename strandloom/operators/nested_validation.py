"""JSON schemas over structs, arrays and maps: compiled to one column expression with messages that say where.

A schema is walked once, beside the type of the column; what comes out is an array of messages, each with the path of the value that it is about (`$.samples[2].sex`). Known are type,
enum, const, pattern, minimum, maximum, minLength, maxLength, required, properties, additionalProperties (false or a schema), dependentRequired, items, minItems, maxItems, uniqueItems, contains,
allOf, anyOf, oneOf, not, if with then and else, and references into the schema's own definitions.

A null is a value that is absent, except inside of arrays, where only the type null admits it. Numbers may come as text. A reference that leads to itself raises an error, since a column's type ends somewhere.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEEPEST = 40
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _none() -> Column:
    return F.array().cast("array<string>")


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _text(c: Column, kind: T.DataType) -> Column:
    return F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")


def _resolve(rule: dict, root: dict, depth: int) -> dict:
    if depth > DEEPEST:
        raise ValueError("the schema is nested too deeply, or a reference leads to itself")
    seen = 0
    while "$ref" in rule:
        at = reduce(lambda d, key: d[key], rule["$ref"].removeprefix("#/").split("/"), root)
        rule = {**at, **{k: v for k, v in rule.items() if k != "$ref"}}
        seen += 1
        if seen > DEEPEST:
            raise ValueError("a reference leads to itself")
    return rule


def _of_type(c: Column, kind: T.DataType, wanted: list[str]) -> Column:
    """Whether a value that is there has one of the types."""
    found = F.lit(False)
    for name in wanted:
        if name in ("number", "integer"):
            if isinstance(kind, _NUMBERS):
                found |= (c.cast("double") == F.floor(c.cast("double"))) if name == "integer" and isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else F.lit(True)
            elif isinstance(kind, T.StringType):
                found |= F.coalesce(c.try_cast("double" if name == "number" else "long").isNotNull(), F.lit(False))
        else:
            found |= F.lit(isinstance(kind, {"string": T.StringType, "boolean": T.BooleanType, "object": (T.StructType, T.MapType), "array": T.ArrayType, "null": T.NullType}[name]))
    return found


def messages(rule: dict | bool, c: Column, kind: T.DataType, path: Column, root: dict, depth: int = 0) -> Column:
    """The messages of a value, an array; empty for one that is absent."""
    if isinstance(rule, bool):
        return _none() if rule else F.when(c.isNotNull(), F.array(F.concat(path, F.lit(": not allowed")))).otherwise(_none())
    rule = _resolve(rule, root, depth)
    inner = lambda r, x=c, k=kind, p=path: messages(r, x, k, p, root, depth + 1)
    said: list[Column] = []
    more: list[Column] = []

    def bad(when: Column, *text) -> None:
        said.append(F.when(when, F.concat(path, F.lit(": "), *[t if isinstance(t, Column) else F.lit(str(t)) for t in text])))

    if "type" in rule:
        wanted = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
        bad(~_of_type(c, kind, wanted), "no ", " or ".join(wanted))
    if "enum" in rule or "const" in rule:
        allowed = rule["enum"] if "enum" in rule else [rule["const"]]
        plain = [v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) for v in allowed]
        bad(~F.coalesce(_text(c, kind).isin(plain), F.lit(False)), "not one of ", ", ".join(plain))
    if isinstance(kind, T.StringType):
        if "pattern" in rule:
            bad(~F.rlike(c, F.lit(rule["pattern"])), f"not like {rule['pattern']}")
        if "minLength" in rule:
            bad(F.length(c) < rule["minLength"], f"shorter than {rule['minLength']}")
        if "maxLength" in rule:
            bad(F.length(c) > rule["maxLength"], f"longer than {rule['maxLength']}")
    if isinstance(kind, (T.StringType, *_NUMBERS)):
        if "minimum" in rule:
            bad(c.try_cast("double") < rule["minimum"], f"below {rule['minimum']}")
        if "maximum" in rule:
            bad(c.try_cast("double") > rule["maximum"], f"above {rule['maximum']}")
    if isinstance(kind, T.StructType):
        fields = {f.name: f.dataType for f in kind}
        absent = lambda name: c.getField(name).isNull() if name in fields else F.lit(True)
        for name in rule.get("required", []):
            bad(absent(name), f"`{name}` is missing")
        for name, needed in rule.get("dependentRequired", {}).items():
            for other in needed:
                bad(~absent(name) & absent(other), f"`{name}` needs `{other}`")
        for name, sub in rule.get("properties", {}).items():
            if name in fields:
                more.append(inner(sub, c.getField(name), fields[name], F.concat(path, F.lit(f".{name}"))))
        extra = rule.get("additionalProperties", True)
        for name in fields:
            if name not in rule.get("properties", {}):
                more.append(inner(extra, c.getField(name), fields[name], F.concat(path, F.lit(f".{name}"))))
    if isinstance(kind, T.MapType) and isinstance(rule.get("additionalProperties"), dict):
        entries = F.map_entries(c)
        more.append(F.flatten(F.transform(entries, lambda e: inner(rule["additionalProperties"], e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))))
    if isinstance(kind, T.ArrayType):
        of = kind.elementType
        if "items" in rule:
            nulls = rule["items"] is not True and "null" not in (rule["items"] or {}).get("type", []) if isinstance(rule["items"], dict) else False

            def one(x: Column, i: Column) -> Column:
                place = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
                found = inner(rule["items"], x, of, place)
                return F.when(x.isNull(), F.array(F.concat(place, F.lit(": null")))).otherwise(found) if nulls else found

            more.append(F.flatten(F.transform(c, one)))
        if "minItems" in rule:
            bad(F.size(c) < rule["minItems"], f"fewer than {rule['minItems']} items")
        if "maxItems" in rule:
            bad(F.size(c) > rule["maxItems"], f"more than {rule['maxItems']} items")
        if rule.get("uniqueItems"):
            bad(F.size(F.array_distinct(c)) < F.size(c), "items come twice")
        if "contains" in rule:
            bad(~F.exists(c, lambda x: x.isNotNull() & (F.size(inner(rule["contains"], x, of)) == 0)), "holds no item that it must")
    more += [inner(sub) for sub in rule.get("allOf", [])]
    fits = lambda subs: sum((F.when(F.size(inner(s)) == 0, 1).otherwise(0) for s in subs), F.lit(0))
    if "anyOf" in rule:
        bad(fits(rule["anyOf"]) == 0, f"fits none of {len(rule['anyOf'])} alternatives")
    if "oneOf" in rule:
        n = fits(rule["oneOf"])
        bad(n != 1, "fits ", n.cast("string"), f" of {len(rule['oneOf'])} alternatives, not one")
    if "not" in rule:
        bad(F.size(inner(rule["not"])) == 0, "is what it must not be")
    if "if" in rule:
        more.append(F.when(F.size(inner(rule["if"])) == 0, inner(rule.get("then", True))).otherwise(inner(rule.get("else", True))))
    own = [F.array_compact(F.array(*said))] if said else []
    return F.when(c.isNotNull(), _joined(own + more)).otherwise(_none())


def nested_errors(rows: DataFrame, schema: dict | str, column: str | None = None) -> Column:
    """The messages of each row of rows: of one column, or of all as an object."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    if column is not None:
        return messages(schema, F.col(column), rows.schema[column].dataType, F.lit("$"), schema)
    return messages(schema, F.struct(*rows.columns), rows.schema, F.lit("$"), schema)


def validate_nested(rows: DataFrame, schema: dict | str, key: str, column: str | None = None) -> DataFrame:
    """key and message of every error."""
    found = rows.select(F.col(key), nested_errors(rows, schema, column).alias("found"))
    return found.select(key, F.explode("found").alias("message"))
