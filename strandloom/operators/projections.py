"""Shapes of results: nested fields promoted or flattened, abridged records, JSON responses and catalogue views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.paging import PAGE_SIZE


def by_id(rows: DataFrame, key: str, value, fields: list[str] | None = None) -> DataFrame:
    """The rows of an id, all columns or some."""
    found = rows.where(F.col(key) == value)
    return found.select(*fields) if fields else found


def promoted(rows: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Structs replaced by their fields, one level; a field that a column of the row, or an earlier struct, has already is left out. rename: new names of the result."""
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, T.StructType)]
    taken, columns = {c.lower() for c in plain}, [F.col(c) for c in plain]
    for f in rows.schema:
        if isinstance(f.dataType, T.StructType):
            for inner in f.dataType.names:
                if inner.lower() not in taken:
                    taken.add(inner.lower())
                    columns.append(F.col(f.name)[inner].alias(inner))
    return rows.select(*columns).withColumnsRenamed(rename or {})


def flattened(rows: DataFrame, separator: str = "_") -> DataFrame:
    """All structs as columns of their own, named by their path. Fields whose metadata say `exclude` are left out, and those with an `order` come first, in it."""
    found: list[tuple[float, int, Column]] = []

    def walk(fields: list[T.StructField], at: Column | None, name: str) -> None:
        for f in fields:
            if f.metadata.get("exclude"):
                continue
            here = F.col(f.name) if at is None else at[f.name]
            path = f.name if at is None else f"{name}{separator}{f.name}"
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType.fields, here, path)
            else:
                found.append((f.metadata.get("order", float("inf")), len(found), here.alias(path)))

    walk(rows.schema.fields, None, "")
    return rows.select(*(c for _, _, c in sorted(found, key=lambda x: x[:2])))


def abridged(tracks: DataFrame, fields: list[str]) -> DataFrame:
    """Tracks with nested fields promoted, then only the named ones and counts (num_...)."""
    flat = promoted(tracks)
    return flat.select(*(c for c in flat.columns if c in fields or c.startswith("num_")))


def json_array(rows: DataFrame, order: list[str], most: int = PAGE_SIZE) -> DataFrame:
    """A page of rows as one JSON array, in order."""
    first = rows.orderBy(*order).limit(most)
    key = F.struct(*order, F.struct(*rows.columns).alias("row"))
    return first.agg(F.to_json(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["row"])).alias("items"))  # a page


def known(column: Column, ids: Column) -> Column:
    """The part of a list of ids that another list has, in the first one's order."""
    return F.filter(column, lambda x: F.array_contains(ids, x))


def with_key(rows: DataFrame, names: DataFrame, column: str, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of what a column names (names: name, key), and the rows whose name isn't known. The names are joined, not kept on the driver."""
    table = names.select(F.col(name).alias("_name"), F.col(key).alias(key)).dropDuplicates(["_name"])
    found = rows.join(table, F.col(column) == F.col("_name"), "inner").drop("_name")
    return found, rows.join(table, F.col(column) == F.col("_name"), "left_anti")


def _some(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def file_view(track_id: Column, name: Column, file: Column, namespace: str = "dataset") -> Column:
    """A track's file as an object of a data repository service: id, name, size, checksums, type and how to get it."""
    checksums = _some(F.array_compact(F.array(F.when(file["md5sum"].isNotNull(), F.struct(F.lit("md5").alias("type"), file["md5sum"].alias("checksum"))))))
    access = _some(F.array_compact(F.array(F.when(file["url"].isNotNull(), F.struct(F.lit("https").alias("type"), file["url"].alias("access_url"))))))
    return F.struct(F.concat(F.lit(f"{namespace}:"), track_id).alias("id"), name.alias("name"), file["file_size"].alias("size"), checksums.alias("checksums"), file["file_format"].alias("mime_type"), access.alias("access_methods"))


def citation_view(track_id: Column, name: Column, description: Column, feature_type: Column, phenotypes: Column, provenance: Column, file: Column, namespace: str = "dataset") -> Column:
    """A track for a citation registry: identifiers, titles, publisher, year, descriptions, subjects, sizes, formats and papers."""
    papers = _some(F.transform(provenance["pubmed_id"], lambda p: F.struct(p.cast("string").alias("relatedIdentifier"), F.lit("IsReferencedBy").alias("relationType"), F.lit("PMID").alias("relatedIdentifierType"))))
    subjects = F.array_compact(F.concat(F.coalesce(phenotypes, F.array().cast("array<string>")), F.array(feature_type)))
    return F.struct(
        F.array(F.struct(F.concat(F.lit(f"{namespace}:"), track_id).alias("identifier"), F.lit("OTHER").alias("identifierType"))).alias("identifiers"),
        F.array(F.struct(name.alias("title"))).alias("titles"),
        provenance["data_source"].alias("publisher"),
        provenance["release_date"].alias("publicationYear"),
        F.array(F.struct(description.alias("description"), F.lit("Abstract").alias("descriptionType"))).alias("descriptions"),
        _some(F.transform(subjects, lambda s: F.struct(s.alias("subject")))).alias("subjects"),
        file["file_size"].cast("string").alias("sizes"),
        file["file_format"].alias("formats"),
        papers.alias("relatedIdentifiers"),
    )


def dataset_view(track_id: Column, name: Column, description: Column, provenance: Column, file: Column, namespace: str = "dataset") -> Column:
    """A track as linked data for search engines, JSON text."""
    download = F.when(
        file["url"].isNotNull(),
        F.struct(F.lit("DataDownload").alias("@type"), file["url"].alias("contentUrl"), F.coalesce(file["file_format"], F.lit("application/x-gzip")).alias("encodingFormat"), F.when(file["file_size"] > 0, F.concat(file["file_size"].cast("string"), F.lit(" bytes"))).alias("contentSize")),
    )
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.array(F.lit("Dataset"), F.lit("https://bioschemas.org/types/Dataset/0.4-RELEASE")).alias("@type"),
            F.concat(F.lit(f"{namespace}:"), track_id).alias("identifier"),
            name.alias("name"),
            description.alias("description"),
            provenance["release_date"].cast("string").alias("datePublished"),
            F.struct(F.lit("Organization").alias("@type"), provenance["data_source"].alias("name")).alias("publisher"),
            download.alias("distribution"),
        )
    )
