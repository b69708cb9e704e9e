"""Variants over reference sequences. The sequences are the names of parts in order, their letters read as bases; each part gives a variant."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import gwas
from strandloom.operators import sequences as S
from strandloom.plans.registry import Tables, query
from strandloom.sources.sequences import in_chunks, read_fasta
from strandloom.staging import stage, text_files

#: Parts in a sequence, and bases in a chunk: small, so that repeats run over the ends of chunks.
PARTS, SIZE = 100, 256
_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz ", "AACAACAGACAATAACAGACAACATAC"
_CONTIGS = f"""contigs AS (SELECT 'c' || CAST(p_partkey // {PARTS} AS VARCHAR) AS name, string_agg(translate(p_name, '{_LETTERS}', '{_BASES}'), '' ORDER BY p_partkey) AS s FROM part GROUP BY 1)"""


def _contigs(t: Tables):
    """name and the whole text of each sequence: a bounded number of parts."""
    part = F.struct("p_partkey", F.translate("p_name", _LETTERS, _BASES).alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["b"]), "")
    return t.part.groupBy(F.concat(F.lit("c"), F.floor(F.col("p_partkey") / PARTS).cast("string")).alias("name")).agg(joined.alias("s"))


def _sequence(t: Tables):
    return stage(in_chunks(_contigs(t).select("name", F.lit(0).cast("long").alias("start"), F.col("s").alias("bases")), SIZE), "sequence")


def _variants(t: Tables):
    """id, name, position, ref and alt: substitutions, insertions, deletions, and both at once."""
    of = _contigs(t).withColumnRenamed("name", "contig")
    rows = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("c"), F.floor(F.col("p_partkey") / PARTS).cast("string")).alias("name"), (F.col("p_partkey") * 37 % 700 + 1).alias("position"), (F.col("p_partkey") % 6).alias("k"), "p_size")
    ref = F.substr("s", F.col("position").cast("int"), F.when(F.col("k") < 3, F.col("k")).when(F.col("k") == 3, 0).otherwise(F.col("k") - 2).cast("int"))
    alt = F.when(F.col("k") == 0, "A").when(F.col("k") == 1, "").when(F.col("k") == 2, "").when(F.col("k") == 3, "AC").when(F.col("k") == 4, F.concat(ref, F.lit("A"))).otherwise("GT")
    return rows.join(of, rows["name"] == of["contig"]).select("id", "name", "position", ref.alias("ref"), alt.alias("alt"))


_VARIANTS = f"""variants AS (
  SELECT id, name, position, s, substr(s, position, CASE WHEN k < 3 THEN k WHEN k = 3 THEN 0 ELSE k - 2 END) AS ref, k
  FROM (SELECT p_partkey AS id, 'c' || CAST(p_partkey // {PARTS} AS VARCHAR) AS name, p_partkey * 37 % 700 + 1 AS position, p_partkey % 6 AS k FROM part) JOIN contigs USING (name)),
given AS (SELECT id, name, position, s, ref, CASE k WHEN 0 THEN 'A' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'AC' WHEN 4 THEN ref || 'A' ELSE 'GT' END AS alt FROM variants)"""

# Each loop of the plain definition is the first place in a list where two texts differ.
_NORMAL = f"""{_CONTIGS}, {_VARIANTS},
tails AS (SELECT *, coalesce(list_min(list_filter(range(0, least(length(ref), length(alt))), lambda k: ref[-1 - k] <> alt[-1 - k])), least(length(ref), length(alt))) AS cut FROM given),
headed AS (SELECT id, name, position, s, substr(ref, 1, length(ref) - cut) AS ref, substr(alt, 1, length(alt) - cut) AS alt FROM tails),
heads AS (SELECT *, coalesce(list_min(list_filter(range(0, least(length(ref), length(alt))), lambda k: ref[1 + k] <> alt[1 + k])), least(length(ref), length(alt))) AS cut FROM headed),
cut AS (SELECT id, name, s, position - 1 + cut AS start, substr(ref, cut + 1) AS ref, substr(alt, cut + 1) AS alt FROM heads),
seeded AS (SELECT *, start + length(ref) AS stop, CASE WHEN (ref = '') <> (alt = '') THEN ref || alt END AS seed FROM cut),
rolled AS (
  SELECT *, CASE WHEN seed IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(0, start), lambda k: s[start - k] <> seed[length(seed) - k % length(seed)])), start) END AS l,
         CASE WHEN seed IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(0, length(s) - stop), lambda k: s[stop + 1 + k] <> seed[1 + k % length(seed)])), length(s) - stop) END AS r
  FROM seeded),
normal AS (SELECT id, name, s, start - l AS start, stop + r AS stop, substr(s, start - l + 1, l) || ref || substr(s, stop + 1, r) AS full_ref, substr(s, start - l + 1, l) || alt || substr(s, stop + 1, r) AS full_alt, l, r, seed FROM rolled)"""


@query(f"WITH {_CONTIGS} SELECT name, CAST(chunk AS BIGINT) AS chunk, substr(s, chunk * {SIZE} + 1, {SIZE}) AS bases FROM (SELECT name, s, unnest(range(0, (length(s) + {SIZE - 1}) // {SIZE})) AS chunk FROM contigs)")
def fasta_chunks(t: Tables):
    """Sequences written as FASTA text with short lines, and read back as chunks."""
    lines = F.concat(F.lit(">"), "name", F.lit(" parts\n"), F.regexp_replace(F.lower("s"), "(.{50})", "$1\n"))
    return read_fasta(t.spark, text_files(_contigs(t).select(lines.alias("value")), "fasta"), SIZE)


@query(f"WITH {_NORMAL} SELECT id, name, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS \"end\", full_ref, full_alt, CAST(l AS BIGINT) AS left_shift, CAST(r AS BIGINT) AS right_shift FROM normal")
def normalised_variants(t: Tables):
    return S.normalised(_variants(t), _sequence(t), SIZE).select("id", "name", "start", "end", "full_ref", "full_alt", "left_shift", "right_shift")


_HGVS = """CASE WHEN full_ref = full_alt THEN CASE WHEN start + 1 >= stop THEN '' || (start + 1) ELSE (start + 1) || '_' || stop END || '='
  WHEN seed IS NULL AND length(full_ref) = 1 AND length(full_alt) = 1 THEN stop || full_ref || '>' || full_alt
  WHEN seed IS NULL THEN CASE WHEN start + 1 = stop THEN '' || stop ELSE (start + 1) || '_' || stop END || 'delins' || full_alt
  WHEN length(full_alt) < length(full_ref) THEN CASE WHEN length(seed) = 1 THEN '' || stop ELSE (stop - length(seed) + 1) || '_' || stop END || 'del'
  WHEN l + r >= length(seed) THEN CASE WHEN length(seed) = 1 THEN '' || stop ELSE (stop - length(seed) + 1) || '_' || stop END || 'dup'
  ELSE stop || '_' || (stop + 1) || 'ins' || substr(seed || seed, CAST(r % length(seed) + 1 AS BIGINT), length(seed)) END"""


@query(f"WITH {_NORMAL} SELECT id, name || ':' || start || ':' || full_ref || ':' || full_alt AS spdi, name || ':g.' || {_HGVS} AS hgvs, CAST(start + 1 AS BIGINT) AS left_position FROM normal")
def spdi_hgvs(t: Tables):
    normal = S.normalised(_variants(t), _sequence(t), SIZE)
    left = S.left_aligned(*map(F.col, ("start", "full_ref", "full_alt", "seed")))
    return normal.select("id", S.spdi(F.col("name"), F.col("start"), F.col("full_ref"), F.col("full_alt")).alias("spdi"), S.genomic_hgvs(F.col("name"), normal).alias("hgvs"), left["position"].alias("left_position"))


@query()
def vrs_ids(t: Tables):
    """Computed identifiers; SHA-512 has no SQL, so tests hold them against Python."""
    sequence = _sequence(t)
    return S.with_vrs(S.normalised(_variants(t), sequence, SIZE), S.sequence_accessions(sequence)).select("id", "accession", "vrs_location_id", "vrs_state", "vrs_id")


@query(f"WITH {_CONTIGS}, {_VARIANTS} SELECT id, CASE WHEN position + length(wanted) - 1 <= length(s) OR wanted = '' THEN substr(s, position, length(wanted)) = wanted END AS ref_matches FROM (SELECT *, CASE WHEN id % 3 = 0 THEN ref || 'A' ELSE ref END AS wanted FROM given)")
def reference_check(t: Tables):
    """Whether the sequence has the given reference alleles; a third of them got a base more."""
    rows = _variants(t).withColumn("ref", F.when(F.col("id") % 3 == 0, F.concat("ref", F.lit("A"))).otherwise(F.col("ref")))
    return S.validated(rows, _sequence(t), SIZE).select("id", "ref_matches")


@query(f"""WITH {_CONTIGS} SELECT p_partkey, base, CASE WHEN p_size % 5 = 0 OR base = 'A' THEN 'valid' WHEN base = 'C' THEN 'swapped' WHEN p_size % 5 = 3 THEN 'dropped' ELSE 'unverified' END AS status
FROM (SELECT p_partkey, p_size, s[p_partkey % 500 + 1] AS base FROM part JOIN contigs ON name = 'c' || CAST(p_partkey // {PARTS} AS VARCHAR))""")
def genome_alleles(t: Tables):
    """Alleles A and C against the base that the sequence has."""
    rows = t.part.select("p_partkey", "p_size", F.concat(F.lit("c"), F.floor(F.col("p_partkey") / PARTS).cast("string")).alias("name"), (F.col("p_partkey") % 500 + 1).alias("position"))
    k = F.col("p_size") % 5
    status = gwas.allele_status(F.when(k == 0, "rs1"), F.lit("A"), F.lit("C"), F.col("genome_base"), k == 3)
    return S.with_genome_base(rows, _sequence(t), SIZE).select("p_partkey", F.col("genome_base").alias("base"), status.alias("status"))
