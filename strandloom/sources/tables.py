"""Delimited files, Parquet, JSON configuration, chromosome maps, and sinks."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sniff(spark: SparkSession, path: str, n: int = 50) -> str:
    """The delimiter of a text file by its first lines."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(n).collect())
    for size in (1024, 4096):
        try:
            return csv.Sniffer().sniff(head[:size], delimiters=",\t;|").delimiter
        except csv.Error:
            continue
    return "\t" if "\t" in head else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, names: list[str] | None = None, infer: bool = True, na: str | None = None) -> DataFrame:
    """A delimited file with trimmed strings; null markers are filled if na is given."""
    df = spark.read.csv(path, sep=sep or sniff(spark, path), header=header, inferSchema=infer)
    if names:
        df = df.toDF(*names)
    df = df.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    return df.na.fill(na) if na is not None else df


def read_lines(spark: SparkSession, path: str, skip: str = "#") -> DataFrame:
    """Lines of a plain or compressed file without those that start with skip or are blank."""
    lines = spark.read.text(path).select(F.rtrim("value").alias("line"))
    return lines.where((F.col("line") != "") & ~F.startswith("line", F.lit(skip)))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Columns and rows are pruned in the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def column_mapping(df: DataFrame, key: str, value: str, many: bool = True) -> DataFrame:
    """key and its sorted distinct values; a second value raises an error unless many."""
    found = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))
    if many:
        return found
    return found.select(key, F.when(F.size("values") > 1, F.raise_error(F.concat(F.lit("several values for "), F.col(key).cast("string")))).otherwise(F.get("values", F.lit(0))).alias(value))


def read_json_record(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_chromosome_map(spark: SparkSession, path: str) -> DataFrame:
    """chromosome and length of a file without header; MT becomes M."""
    raw = spark.read.csv(path, sep="\t", schema="chr string, length long")
    name = F.regexp_replace("chr", "^(chr)?MT$", "chrM")
    return raw.select(F.when(F.startswith(name, F.lit("chr")), name).otherwise(F.concat(F.lit("chr"), name)).alias("chromosome"), "length")


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A worksheet through pandas, where an Excel reader is installed."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, fetch: int = 5000) -> DataFrame:
    """A database table in ranges of a numeric column."""
    options = {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": parts, "fetchsize": fetch}
    return spark.read.format("jdbc").options(**{k: str(v) for k, v in options.items()}).load()


def export(df: DataFrame, path: str, columns: list[str], where: dict[str, object] | None = None, format: str = "tab") -> None:
    """Columns and rows by equality as JSON, tab- or comma-separated files with NULL for null."""
    out = filtered(df, columns, where)
    if format == "json":
        out.write.json(path)
    else:
        out.write.csv(path, sep="\t" if format == "tab" else ",", header=True, nullValue="NULL")


def filtered(df: DataFrame, columns: list[str], where: dict[str, object] | None = None) -> DataFrame:
    for name, value in (where or {}).items():
        df = df.where(F.col(name) == value)
    return df.select(*columns)


def one_record(df: DataFrame, columns: list[str], where: dict[str, object]) -> DataFrame:
    """The row that a lookup by equality finds; several rows are an error when the result is read, none is none."""
    found = filtered(df, [*columns], where) if set(where) <= set(columns) else filtered(df, [*columns, *(c for c in where if c not in columns)], where).select(*columns)
    few = found.limit(2)
    n = few.agg(F.count("*").alias("_n"))
    checked = few.crossJoin(n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("several rows for a lookup of one"))).otherwise(F.col("_n")))  # two rows at most
    return checked.where("_n = 1").select(*columns)


#: The first columns of a BED file, in their order.
BED_COLUMNS = ["chrom", "chromStart", "chromEnd", "name", "score", "strand"]


def bed_rows(df: DataFrame, names: dict[str, str], header: bool = False) -> DataFrame:
    """Lines of a BED file in column `line`: its own columns first, in their order and under the names that names gives them (column to BED name), then the others. Null is a full stop. header: a first line of names, in a row of its own."""
    of = {bed: c for c, bed in names.items()}
    columns = [of[b] for b in BED_COLUMNS if b in of] + [c for c in df.columns if c not in names]
    lines = df.select(bed_row(columns).alias("line"))
    if not header:
        return lines
    first = df.sparkSession.createDataFrame([("#" + "\t".join(names.get(c, c) for c in columns),)], "line string")
    return first.unionByName(lines)


def table_view(df: DataFrame) -> DataFrame:
    """column, title, type and place of the columns of a table response: numbers are told apart from text, titles come from the fields' metadata or their names."""
    kinds = {"string": "text", "boolean": "boolean", "date": "date"}
    numeric = ("int", "bigint", "smallint", "tinyint", "float", "double")
    kind = lambda t: "number" if t in numeric or t.startswith("decimal") else kinds.get(t, "json" if t.startswith(("struct", "array", "map")) else "text")
    rows = [(f.name, f.metadata.get("title", f.name.replace("_", " ").capitalize()), kind(f.dataType.simpleString()), k) for k, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "column string, title string, type string, place int")


def text_row(columns: list[str], null: str = "NA", sep: str = "\t") -> Column:
    """A row as one line of text."""
    return F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns))


def bed_row(columns: list[str]) -> Column:
    return text_row(columns, ".")


def write_associations(df: DataFrame, full: str, brief: str, pvalue_columns: list[str]) -> None:
    """All statistics, and the p-values alone."""
    df.write.csv(full, sep="\t", header=True, nullValue="NULL")
    df.select(*pvalue_columns).write.csv(brief, sep="\t", header=True, nullValue="NULL")


def write_triples(triples: DataFrame, path: str, base: str = "http://example.org/") -> None:
    """subject, predicate, object as N-Triples (which are Turtle too). An object_kind column may say literal or blank of an object; everything else is an IRI: names are percent-encoded below base, and whole http IRIs stay."""
    plain = lambda c: F.regexp_replace(F.url_encode(F.col(c)), r"\+", "%20")
    whole = lambda c: F.regexp_replace(F.col(c), r"[\x00-\x20<>\"{}|^`\\\\]", "")
    blank = lambda c: F.startswith(F.col(c), F.lit("_:"))
    node = lambda c: F.when(blank(c), F.concat(F.lit("_:b"), F.hex(F.substr(c, F.lit(3))))).when(F.col(c).rlike("^https?://"), F.concat(F.lit("<"), whole(c), F.lit(">"))).otherwise(F.concat(F.lit(f"<{base}"), plain(c), F.lit(">")))
    text = F.col("object")
    for sign, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(sign), F.lit(escaped))
    kind = F.col("object_kind") if "object_kind" in triples.columns else F.lit("iri")
    thing = F.when(kind == "literal", F.concat(F.lit('"'), text, F.lit('"'))).otherwise(node("object"))
    rows = triples.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
    rows.select(F.concat_ws(" ", node("subject"), node("predicate"), thing, F.lit("."))).write.text(path)


def read_ntriples(spark: SparkSession, path: str, base: str = "http://example.org/") -> DataFrame:
    """subject, predicate, object and object_kind of N-Triples: names below base decoded, other IRIs whole, blank nodes as `_:` and their text, literals unescaped (a language or type is dropped)."""
    line = F.trim("value")
    part = lambda k: F.regexp_extract(line, r'^(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*")', k)

    def node(c: Column) -> Column:
        iri = F.substr(c, F.lit(2), F.length(c) - 2)
        own = F.concat(F.lit("_:"), F.coalesce(F.unhex(F.regexp_extract(c, "^_:b([0-9A-F]+)$", 1)).cast("string"), F.lit("")))
        return F.when(F.startswith(c, F.lit("_:")), F.when(c.rlike("^_:b([0-9A-F]{2})+$"), own).otherwise(c)).when(F.startswith(iri, F.lit(base)), F.url_decode(F.substr(iri, F.lit(len(base) + 1)))).otherwise(iri)

    # Escapes are undone in one pass: a backslash that was escaped can't begin another escape.
    inner = F.substr(part(3), F.lit(2), F.length(part(3)) - 2)
    pieces = F.regexp_extract_all(inner, F.lit(r"(?s)(\\.|[^\\]+)"), 1)
    plain = F.array_join(F.transform(pieces, lambda x: F.when(x == "\\n", "\n").when(x == "\\r", "\r").when(x == "\\t", "\t").when(F.startswith(x, F.lit("\\")), F.substr(x, F.lit(2))).otherwise(x)), "")
    literal = F.startswith(part(3), F.lit('"'))
    rows = spark.read.text(path).where(line.rlike(r"^(<|_:)"))
    return rows.select(node(part(1)).alias("subject"), node(part(2)).alias("predicate"), F.when(literal, plain).otherwise(node(part(3))).alias("object"), F.when(literal, "literal").when(F.startswith(part(3), F.lit("_:")), "blank").otherwise("iri").alias("object_kind"))
