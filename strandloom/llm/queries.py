"""The queries of this subpackage: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm._shared import ship, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents"), 24)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.token_files import read_token_files, token_folder, write_token_files

    folder = token_folder(spark)
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), 4096)
    length = F.octet_length("ids") / 4
    return out.select("doc_id", "piece", "start", length.cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def _four_batches(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Totals after four batches: all documents enter as words and under a tokenizer; those with an even n_chars leave the latter; English ones are revised from words to it; a batch comes twice."""
    from strandloom.llm._shared import new_folder, staged
    from strandloom.llm.rollups import Rollup, counted_changes, with_counts

    spark = docs.sparkSession
    store = Rollup(spark, new_folder(spark, "rollup"))
    rows = docs.select("source", "lang", "text", F.col("n_chars").alias("chars"))
    counted = staged(with_counts(rows, [("text", "words-1", "words"), ("text", tokenizer, "tokens")], keep=("chars",)), "counted")
    store.commit("words", counted_changes(counted, "insert", "words-1", "words"))
    store.commit("pieces", counted_changes(counted, "insert", tokenizer, "tokens"))
    gone = counted_changes(counted.where(F.col("chars") % 2 == 0), "delete", tokenizer, "tokens")
    store.commit("withdrawn", gone)
    store.compact()
    store.commit("revised", counted_changes(counted.where(F.col("lang") == "en"), "revise", tokenizer, "tokens", old=("words", "words-1")))
    store.commit("withdrawn", gone)  # a batch that comes again changes nothing
    return store.totals()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of words and of a vocabulary's tokens after four batches."""
    return _four_batches(table(spark, sf_dir, "documents"), "word-bpe-49k")


def token_counts_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a tokenizer that SQL can express."""
    return _four_batches(table(spark, sf_dir, "documents"), "pieces-1")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.mixing import mix

    rows = mix(table(spark, sf_dir, "documents"))
    first = rows.where(F.col("epoch").isNull() | (F.col("epoch") == 0))
    return first.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "shard")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.jaccard import similar_components

    return similar_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.language import fit, predict

    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    coder = fit(docs, remainder != 0)
    out = predict(docs.select("doc_id", "text"), coder)
    return out.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.quality import judge

    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.substring import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_copied", "removed_bytes", "removed_spans")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandloom.llm import byte_bpe

    how = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *how).select("doc_id", "ids")
    out = byte_bpe.decode(ids, *how)
    digest = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.whitening import fit, whiten

    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))


def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_sharding, op2_token_files, op3_packing, op4_token_counts, token_counts_by_pattern, op5_mixing, op6_jaccard, op7_language, op8_quality, op9_substring, op10_topk, op11_filter_audit, op12_byte_bpe, op13_whitening)}

_OP4_SQL = r"""
WITH counted AS (
  SELECT source, lang, n_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', '@', 'g')) - length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS words,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9]+')) AS BIGINT) AS pieces
  FROM documents),
signed AS (
  SELECT source, lang, 'words-1' AS tokenizer, 1 AS n, words AS t FROM counted
  UNION ALL SELECT source, lang, 'pieces-1', 1, pieces FROM counted
  UNION ALL SELECT source, lang, 'pieces-1', -1, -pieces FROM counted WHERE n_chars % 2 = 0
  UNION ALL SELECT source, lang, 'pieces-1', 1, pieces FROM counted WHERE lang = 'en'
  UNION ALL SELECT source, lang, 'words-1', -1, -words FROM counted WHERE lang = 'en')
SELECT source, lang, tokenizer, CAST(sum(n) AS BIGINT) AS n_docs, CAST(sum(t) AS BIGINT) AS n_tokens
FROM signed GROUP BY ALL HAVING sum(n) <> 0 OR sum(t) <> 0
"""

_OP6_SQL = r"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[k:k + 4] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * i >= 80 * (m.n + n.n - i)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT r.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.other) AS component_id FROM reach r LEFT JOIN sizes n ON n.doc_id = r.doc_id GROUP BY r.doc_id, n.n
"""


def _op8_sql() -> str:
    from strandloom.llm.quality import RULES, STOP_WORDS

    bounds = {r.measure: r for r in RULES}
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, k, w[k:k + 7] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM parts WHERE len(w) >= 8)),
twice AS (SELECT doc_id, v FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM windows JOIN twice USING (doc_id, v), range(0, 8) AS r(j) GROUP BY 1),
measures AS (
  SELECT p.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: rtrim(x, '.,') IN ({stops}))) AS n_stop, len(l) AS n_lines
  FROM parts p LEFT JOIN covered c ON c.doc_id = p.doc_id),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN {bounds["mean_word_length"].least} AND {bounds["mean_word_length"].most} AND n_symbols / n_words <= {bounds["symbol_ratio"].most}
       AND n_stop / n_words >= {bounds["stop_word_ratio"].least} AND n_dup_lines / n_lines <= {bounds["dup_line_ratio"].most} AS kept
FROM base
"""


_OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

_OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
marks AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS mask
  FROM d JOIN least USING (text) LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (
  SELECT o, step, 1 << (ascii(o[step]) - 65) AS bit, CAST(coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(o[k]) - 65))), 0) AS INTEGER) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
sums AS (
  SELECT part, o, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, o, step, bit)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM sums
"""

ORACLE_SQL: dict[str, str] = {"token_counts_by_pattern": _OP4_SQL, "op6_jaccard": _OP6_SQL, "op8_quality": _op8_sql(), "op10_topk": _OP10_SQL, "op11_filter_audit": _OP11_SQL}
