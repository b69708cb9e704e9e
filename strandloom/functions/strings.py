"""Column functions over strings, numbers, lists and maps. All run in the JVM but what Spark lacks: two digests, and numbers rounded as C's printf does."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Distinct lower-case words; an empty set for blank text."""
    parts = F.split(F.trim(F.lower(text)), r"\s+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def jaccard_words(a: Column, b: Column) -> Column:
    """Shared words over all words, 0 if there are none."""
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def info_string(fields: Column) -> Column:
    """k=v pairs of a map sorted by key and joined with `;`, null values as `.`."""
    pairs = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit(".")))))
    return F.array_join(pairs, ";")


def parse_info(text: Column) -> Column:
    """A map from `k=v;flag;...`: the first `=` splits, flags are `true`; null for null or `.`."""
    parts = F.filter(F.split(text, ";"), lambda p: p != "")
    entry = lambda p: F.when(F.instr(p, "=") > 0, F.struct(F.substring_index(p, "=", 1).alias("key"), F.substr(p, F.instr(p, "=") + 1).alias("value"))).otherwise(F.struct(p.alias("key"), F.lit("true").alias("value")))
    return F.when(text.isNull() | (text == "."), F.lit(None)).otherwise(F.map_from_entries(F.transform(parts, entry)))


def truncate(text: Column, n: int) -> Column:
    """At most n characters, the last three `...` where text was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def snake_case(text: Column) -> Column:
    return F.replace(F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2")), F.lit(" "), F.lit("_"))


def camel_case(text: Column) -> Column:
    parts = F.split(text, "_")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.initcap), ""))


def int_to_alpha(n: Column) -> Column:
    """1 is A, and so on past Z through the code points."""
    return F.char(64 + n)


def is_balanced(text: Column, start: str = "(", end: str = ")") -> Column:
    """Whether every start has its end, none before."""
    step = lambda a, c: F.struct(
        (a["depth"] + F.when(c == start, 1).when(c == end, -1).otherwise(0)).alias("depth"),
        (a["ok"] & ~((c == end) & (a["depth"] <= 0))).alias("ok"),
    )
    return F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok")), step, lambda a: a["ok"] & (a["depth"] == 0))


def to_number(text: Column) -> Column:
    """A long for whole numbers, also written as integral floats; else null."""
    value = text.try_cast("double")
    return F.coalesce(text.try_cast("long"), F.when(F.floor(value) == value, value.try_cast("long")))


def to_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "t", "yes", "y"), True).when(low.isin("false", "0", "f", "no", "n"), False)


def is_null_text(text: Column) -> Column:
    """Null, empty, or one of the tokens that files write for null."""
    return text.isNull() | F.lower(F.trim(text)).isin("", "null", "na", "n/a", "none", ".", "not reported")


def alphabetize(text: Column, separator: str = ",") -> Column:
    return F.array_join(F.array_sort(F.split(text, separator)), separator)


def _printf(x: Column, form: str) -> Column:
    """A float as C's printf writes it, by an Arrow-batched function: the exact binary value is rounded, a tie to the even digit. Spark's own formats round the shortest decimal text instead, a tie upwards."""
    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: form % v)

    return F.when(x.isNotNull(), shown(x.cast("double")))


def sci_notation(x: Column, digits: int = 2) -> Column:
    return _printf(x, f"%.{digits}e")


def frequency_format(f: Column) -> Column:
    """0 as `0`, below a thousandth in scientific notation with one digit, else three decimals."""
    return F.when(f == 0, F.lit("0")).when((f > 0) & (f < 0.001), sci_notation(f, 1)).otherwise(F.round(f, 3).cast("string"))


def sanitise(text: Column) -> Column:
    """HTML's special characters as entities."""
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def chunked(items: Column, size: int) -> Column:
    """An array in pieces of at most size."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * size + 1, size))


def blake2b(column: Column, size: int = 20) -> Column:
    """Hex digest, by an Arrow-batched function."""
    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.blake2b(v.encode("utf-8"), digest_size=size).hexdigest())

    return digest(column)


def stable_uuid(column: Column) -> Column:
    """A version-5 UUID of the text's SHA-256, by an Arrow-batched function."""
    @F.pandas_udf("string")
    def make(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, hashlib.sha256(v.encode("utf-8")).hexdigest())))

    return make(column)


def as_text(column: Column, kind: str, null: str = "NA", false_is_null: bool = False) -> Column:
    """Any value as text: lists joined by commas, maps and structs as JSON, dates as year-month-day, null as a word; false too if wanted. kind: the column's Spark type."""
    if kind.startswith("array"):
        text = F.array_join(F.transform(column, lambda x: x.cast("string")), ",", null)
    elif kind.startswith(("map", "struct")):
        text = F.to_json(column)
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        text = F.date_format(column, "yyyy-MM-dd")
    else:
        text = column.cast("string")
    if kind == "boolean" and false_is_null:
        text = F.when(column, text)
    return F.coalesce(text, F.lit(null))


def thousands(x: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(x, 0)


def fixed(x: Column, digits: int = 2) -> Column:
    """A plain decimal number with so many places and no commas."""
    return _printf(x, f"%.{digits}f")


def joined(items: Column, separator: str = ",", distinct: bool = False) -> Column:
    """A list as text; a set of its values, in order of their first place, if wanted."""
    return F.array_join(F.transform(F.array_distinct(items) if distinct else items, lambda x: x.cast("string")), separator)


def found_in(items: Column, word: Column, ignore_case: bool = False) -> Column:
    """The items that hold a word."""
    low = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    return F.filter(items, lambda x: F.contains(low(x), low(word)))


def any_in_text(items: Column, text: Column) -> Column:
    """Whether a text holds one of the items."""
    return F.exists(items, lambda x: F.contains(text, x))


def numbered_items(items: Column) -> Column:
    """A map from item to its place, from 1; of equal items the last counts."""
    pairs = F.transform(items, lambda x, i: F.struct(x.alias("key"), (i + 1).alias("value")))
    last = F.filter(pairs, lambda p: F.size(F.filter(pairs, lambda q: (q["key"] == p["key"]) & (q["value"] > p["value"]))) == 0)
    return F.map_from_entries(last)


def pruned(fields: Column, drop: list[str] | None = None) -> Column:
    """A map without its null and empty values, and without the named keys."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & (v != "") & ~k.isin(drop or [""]))


def none_left(values: Column) -> Column:
    """Whether a list has nothing but nulls."""
    return F.size(F.array_compact(values)) == 0


def pubmed_curie(url: Column) -> Column:
    """PMID:n of a PubMed address."""
    return F.concat(F.lit("PMID:"), F.nullif(F.regexp_extract(url, r"(\d+)/?$", 1), F.lit("")))


def term_id(uri: Column) -> Column:
    """The id behind the last slash of a term's address."""
    return F.substring_index(uri, "/", -1)


def is_number(text: Column) -> Column:
    """Whether a text is a number, also one that isn't finite."""
    return text.try_cast("double").isNotNull()


def is_integer(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"^\s*[+-]?\d+\s*$")), F.lit(False))


def is_float(text: Column) -> Column:
    """A number that isn't written as a whole one."""
    return is_number(text) & ~is_integer(text)


#: Ways to write a day, the usual one first.
DATES = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "d MMM yyyy")


def to_day(text: Column) -> Column:
    """The day of a text in one of DATES; else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATES))
