"""Text records: tokens, chunks, hashes, neighbours, merged definitions, graph walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.strings import jaccard_words
from strandloom.staging import stage

#: Fixed values.
STOPWORDS = ["the", "and", "of", "in", "on", "for", "with", "a", "an", "to", "by", "from", "is", "are", "was", "were", "study", "studies", "patients", "subjects", "using"]
NEIGHBOURS = 250
CHUNK_CHARS = 2000


def tokens(text: Column) -> Column:
    """Lower-case tokens of letters, digits and dashes, longer than one character and no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9\-]+)"), F.lit(1)), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def chunks(sentence_list: Column, most: int = CHUNK_CHARS) -> Column:
    """Sentences packed greedily into texts of at most so many characters; a longer sentence is alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, s: Column) -> Column:
        full = (a["now"] != "") & (F.length(a["now"]) + F.length(s) + 1 > most)
        return F.struct(
            F.when(full, F.array_append(a["done"], a["now"])).otherwise(a["done"]).alias("done"),
            F.when(full | (a["now"] == ""), s).otherwise(F.concat_ws(" ", a["now"], s)).alias("now"),
        )

    return F.aggregate(sentence_list, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def text_hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, query: list[float], k: int = NEIGHBOURS, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows most like one query vector, by cosine."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(id_col, cosine(F.col(column), q).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def merged_definition(old: Column, new: Column, same_namespace: Column) -> Column:
    """The new definition where there was none, in the same namespace, or where it says something else at more length."""
    other = (jaccard_words(old, new) < 0.5) & (F.length(new) > F.length(old))
    return F.when(old.isNull() | (old == ""), new).when(old == new, old).when(same_namespace, new).when(other, new).otherwise(old)


def merged_synonyms(old: Column, new: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(old, empty), F.coalesce(new, empty)))


def ontology_text(term: Column, label: Column, curie: Column, definition: Column, synonyms: Column, namespace: Column) -> Column:
    """The text of an ontology term that is embedded; parts that are null are left out."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    return F.concat_ws("\n", line("Term", term), line("Label", label), line("CURIE", curie), line("Definition", definition), F.transform(synonyms, lambda s: F.concat(F.lit("Synonym: "), s)), line("Namespace", namespace))


def reach(edges: DataFrame, start: DataFrame, depth: int, source: str = "a", target: str = "b") -> DataFrame:
    """Nodes within so many steps of start (node), with the least number of steps. Each step is one join of what is new, written once."""
    new = stage(start.select("node").distinct().withColumn("steps", F.lit(0)), "reach")
    seen = new
    for k in range(1, depth + 1):
        step = edges.join(new.select(F.col("node").alias(source)), source).select(F.col(target).alias("node")).distinct()
        new = stage(step.join(seen.select("node"), "node", "left_anti").withColumn("steps", F.lit(k)), "reach")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows with new values where the key comes again, and the new rows; of equal keys in one file the first (by `line`) counts."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("line"))).where("_n = 1").drop("_n", "line")
    e, n = existing.alias("e"), first.alias("n")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"e.{c}")).alias(c) for c in existing.columns]
    return e.join(n, F.col(f"e.{key}") == F.col(f"n.{key}"), "full").select(*cols)


def triples(rows: DataFrame) -> DataFrame:
    """subject, predicate and object of class, subclass, term columns."""
    pair = lambda s, p, o: F.struct(F.col(s).alias("subject"), F.lit(p).alias("predicate"), F.col(o).alias("object"))
    all_pairs = F.array(pair("subclass", "subClassOf", "class"), pair("term", "subClassOf", "subclass"))
    return rows.select(F.explode(all_pairs).alias("t")).select("t.*").where("subject is not null and object is not null").distinct()


def spark_embed(docs: DataFrame, embed, text: str = "text", batch: int = 128) -> DataFrame:
    """docs with an embedding column from a function of a list of texts to a list of vectors, applied in batches."""
    from pyspark.sql import types as T

    def run(frames):
        for frame in frames:
            out = []
            for low in range(0, len(frame), batch):
                out += [list(map(float, v)) for v in embed(frame[text].iloc[low : low + batch].tolist())]
            yield frame.assign(embedding=out)

    return docs.mapInPandas(run, T.StructType([*docs.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def embedded_text(tracks: DataFrame, key: str, exclude: list[str] | None = None) -> DataFrame:
    """key, text and its digest: a row as JSON without the fields that exclude names or whose metadata say `exclude_from_embeddings`."""
    kept = [f.name for f in tracks.schema if f.name not in (exclude or []) and not f.metadata.get("exclude_from_embeddings")]
    return tracks.select(key, F.to_json(F.struct(*kept)).alias("text")).withColumn("digest", F.sha2("text", 256))


def chunk_rows(texts: DataFrame, key: str, most: int = CHUNK_CHARS) -> DataFrame:
    """key, place (from 0), chunk and its digest of texts (key, text)."""
    rows = texts.select(key, F.posexplode(chunks(sentences(F.col("text")), most)).alias("place", "chunk"))
    return rows.withColumn("digest", F.sha2("chunk", 256))


def known_terms(spark: SparkSession, rows: list[tuple[str, str, list[str]]]) -> DataFrame:
    return spark.createDataFrame(rows, "curie string, term string, synonyms array<string>")
