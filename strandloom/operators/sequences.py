"""Variants over a reference sequence: validation, fully justified alleles, and identifiers computed from them.

The sequence is a table of chunks (name, chunk, bases; see sources.sequences). A variant joins the chunk that it needs
by equality, so a crowded place is a skewed key whose rows can be split. An insertion or deletion in a
repeat is rolled to both ends of the repeat; as what it rolls over repeats its own bases, the
bases on both sides are known without reading them again. Where a roll reaches the end of a chunk, and only there, the next chunk is
asked for in another round.

Variants are rows with name (of the sequence), position (from 1), ref and alt; `-`, empty and null alleles are empty. All columns of the input stay. Rows whose name
or position is null, or whose place the sequence lacks, have null results. N in a sequence stands for an unknown base: no allele rolls over it.
"""

from __future__ import annotations

import hashlib
from base64 import urlsafe_b64encode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.sources.sequences import CHUNK
from strandloom.staging import stage

NORMALISED = ("start", "end", "full_ref", "full_alt", "left_shift", "right_shift", "seed")


def _allele(c: Column | str) -> Column:
    c = F.upper(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.when(c == "-", "").otherwise(c)


def common_prefix(a: Column, b: Column, steps: int) -> Column:
    """Length of the common prefix of two texts, below 2^steps: halving, so a few comparisons of substrings."""
    powers = F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)])
    same = lambda n, p: (F.substr(a, n + 1, p) == F.substr(b, n + 1, p)) & (F.length(F.substr(a, n + 1, p)) == p)
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when(same(n, p), n + p).otherwise(n))


def _steps(most: int) -> int:
    return max(1, most.bit_length())


def trimmed(variants: DataFrame, most: int = 1 << 20) -> DataFrame:
    """variants with start (from 0), end, ref_ and alt_: the alleles without their common suffix, then their common prefix. most: the longest allele that is trimmed."""
    rows = variants.select("*", _allele("ref").alias("ref_"), _allele("alt").alias("alt_"))
    suffix = common_prefix(F.reverse("ref_"), F.reverse("alt_"), _steps(most))
    rows = rows.withColumn("cut_", suffix)
    keep = lambda c: F.substr(F.col(c), F.lit(1), F.length(c) - F.col("cut_"))
    rows = rows.withColumns({"ref_": keep("ref_"), "alt_": keep("alt_")})
    rows = rows.withColumn("cut_", common_prefix(F.col("ref_"), F.col("alt_"), _steps(most)))
    rest = lambda c: F.substr(F.col(c), F.col("cut_") + 1)
    start = F.col("position").cast("long") - 1 + F.col("cut_")
    rows = rows.withColumns({"ref_": rest("ref_"), "alt_": rest("alt_"), "start": start})
    return rows.withColumn("end", F.col("start") + F.length("ref_")).drop("cut_")


def _tape(seed: Column, phase: Column, size: int) -> Column:
    """seed over and over from its phase-th base on, size bases at least."""
    turn = F.pmod(phase, F.length(seed)).cast("int")
    turned = F.concat(F.substr(seed, turn + 1), F.substr(seed, F.lit(1), turn))
    return F.repeat(turned, (F.lit(size) / F.length(seed)).cast("int") + 1)


def _roll(rows: DataFrame, sequence: DataFrame, size: int, left: bool) -> DataFrame:
    """One chunk further on one side, for the rows that are open there: rolled_ grows, open_ says whether the roll may go on in the next chunk. Rows whose chunk is missing end."""
    side = "left" if left else "right"
    rolled, still = f"{side}_shift", f"{side}_open"
    place = F.col("start") - 1 - F.col(rolled) if left else F.col("end") + F.col(rolled)
    rows = rows.withColumn("at_", F.when(F.col(still) & (place >= 0), place))
    chunks = sequence.select(F.col("name").alias("name_"), F.col("chunk").alias("chunk_"), F.col("bases").alias("bases_"))
    rows = rows.join(chunks, (rows["name"] == F.col("name_")) & (F.floor(F.col("at_") / size) == F.col("chunk_")), "left")
    inside = (F.col("at_") - F.col("chunk_") * size).cast("int")
    seed = F.reverse("seed") if left else F.col("seed")
    ahead = F.reverse(F.substr("bases_", F.lit(1), inside + 1)) if left else F.substr(F.col("bases_"), inside + 1)
    ahead = F.translate(ahead, "N", ".")
    grown = F.when(F.col("chunk_").isNotNull(), common_prefix(ahead, _tape(seed, F.col(rolled), size), _steps(size))).otherwise(0)
    rows = rows.withColumn("grown_", grown)
    whole = (F.length(ahead) > 0) & (F.col("grown_") == F.length(ahead)) & F.col("chunk_").isNotNull()  # no bases ahead: the sequence ends
    rows = rows.withColumns({rolled: F.col(rolled) + F.col("grown_"), still: whole})
    return rows.drop("at_", "name_", "chunk_", "bases_", "grown_")


def normalised(variants: DataFrame, sequence: DataFrame, size: int = CHUNK) -> DataFrame:
    """variants with NORMALISED: the fully justified allele from start to end (from 0, half open) with its bases there and instead, how far it can be shifted to the left
    and right of where it was given, and the bases that are inserted or deleted (null for anything else, which is only trimmed)."""
    clash = [c for c in variants.columns if c in {*NORMALISED, "ref_", "alt_"}]
    rows = trimmed(variants.drop(*clash))
    one_sided = (F.col("ref_") == "") != (F.col("alt_") == "")
    rows = rows.withColumns({"seed": F.when(one_sided, F.concat("ref_", "alt_")), "left_shift": F.lit(0).cast("long"), "right_shift": F.lit(0).cast("long"), "left_open": one_sided, "right_open": one_sided})
    rows = stage(rows, "trimmed")  # both parts read it
    done, rolling = rows.where("NOT left_open"), rows.where("left_open")
    out = [done]
    while True:
        # Nearly all rolls end in their first chunk; a long repeat takes a round for each chunk.
        rolling = stage(_roll(_roll(rolling, sequence, size, True), sequence, size, False), "rolled")
        out.append(rolling.where("NOT left_open AND NOT right_open"))
        rolling = rolling.where("left_open OR right_open")
        if rolling.isEmpty():
            break
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    left = F.coalesce(F.reverse(F.substr(_long_tape(F.reverse("seed"), F.col("left_shift")), F.lit(1), F.col("left_shift").cast("int"))), F.lit(""))
    right = F.coalesce(F.substr(_long_tape(F.col("seed"), F.col("right_shift")), F.lit(1), F.col("right_shift").cast("int")), F.lit(""))
    known = F.col("start").isNotNull() & F.col("name").isNotNull()
    value = lambda c: F.when(known, c)
    full = {"full_ref": value(F.concat(left, "ref_", right)), "full_alt": value(F.concat(left, "alt_", right)), "start": value(F.col("start") - F.col("left_shift")), "end": value(F.col("end") + F.col("right_shift"))}
    return rows.withColumns(full).drop("ref_", "alt_", "left_open", "right_open")


def _long_tape(seed: Column, n: Column) -> Column:
    """seed repeated to n bases at least."""
    return F.repeat(seed, (n / F.length(seed)).cast("int") + 1)


def validated(variants: DataFrame, sequence: DataFrame, size: int = CHUNK, key: str = "id") -> DataFrame:
    """variants with ref_matches: whether the sequence has the reference allele at its place (null: no place, or the sequence ends before). key tells rows apart.

    A long allele is compared chunk by chunk; only whether the parts agree comes together."""
    rows = variants.select(F.col(key).alias("key_"), F.col("name").alias("name_"), (F.col("position").cast("long") - 1).alias("at_"), _allele("ref").alias("ref_")).where("at_ >= 0 AND ref_ <> ''")
    first, last = F.floor(F.col("at_") / size), F.floor((F.col("at_") + F.length("ref_") - 1) / size)
    parts = rows.select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("chunk_"))
    low, high = F.greatest(F.col("at_"), F.col("chunk_") * size), F.least(F.col("at_") + F.length("ref_"), (F.col("chunk_") + 1) * size)
    parts = parts.select("key_", "name_", "chunk_", (low - F.col("chunk_") * size).cast("int").alias("inside_"), F.substr("ref_", (low - F.col("at_") + 1).cast("int"), (high - low).cast("int")).alias("part_"))
    met = parts.join(sequence.withColumnsRenamed({"name": "name_", "chunk": "chunk_", "bases": "bases_"}), ["name_", "chunk_"], "left")
    there = F.substr("bases_", F.col("inside_") + 1, F.length("part_"))
    agreed = met.groupBy("key_").agg(F.bool_and(F.coalesce(there == F.col("part_"), F.lit(False))).alias("same_"), F.bool_and(F.length(F.coalesce(there, F.lit(""))) == F.length("part_")).alias("inside_"))
    joined = variants.join(agreed, variants[key] == F.col("key_"), "left")
    empty = F.col("name").isNotNull() & F.col("position").isNotNull() & (_allele("ref") == "")
    return joined.select(*[variants[c] for c in variants.columns], F.when(empty, True).when(F.col("inside_"), F.col("same_")).alias("ref_matches"))


def sequence_accessions(sequence: DataFrame) -> DataFrame:
    """name, accession and length: the truncated SHA-512 digest of each whole sequence. The chunks of a sequence pass one task in order, one batch at a time, since a digest is sequential."""

    def digest(frames):
        name, state, length = None, None, 0
        for frame in frames:
            for now, bases in zip(frame["name"], frame["bases"], strict=True):
                if state is None or now != name:
                    if state is not None:
                        yield _accession(name, state, length)
                    name, state, length = now, hashlib.sha512(), 0
                state.update(bases.encode("ascii"))
                length += len(bases)
        if state is not None:
            yield _accession(name, state, length)

    rows = sequence.where(F.col("name").isNotNull()).repartition("name").sortWithinPartitions("name", "chunk")
    return rows.select("name", "bases").mapInPandas(digest, "name string, accession string, length long")


def _accession(name: str, state, length: int) -> pd.DataFrame:
    return pd.DataFrame({"name": [name], "accession": ["SQ." + urlsafe_b64encode(state.digest()[:24]).decode()], "length": [length]})


def short_digest(text: Column) -> Column:
    """The first 24 bytes of SHA-512 in base64 for URLs."""
    return F.translate(F.base64(F.unhex(F.substring(F.sha2(text.cast("binary"), 512), 1, 48))), "+/", "-_")


def repeat_unit(full_ref: Column, full_alt: Column, seed: Column) -> Column:
    """Bases in the unit that, repeated, makes the alternative sequence from the reference's own; null where it doesn't come from it.

    A deletion does, with the deleted bases as the unit. An insertion does if the greatest divisor of its length that the
    justified reference still holds gives a unit whose repetition goes on to the alternative sequence's end."""
    n, ref, alt = F.length(seed), F.length(full_ref), F.length(full_alt)
    divisors = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda d: (n % d == 0) & (d <= ref))
    makes = lambda d: F.substr(F.concat(full_ref, F.repeat(F.substr(full_ref, ref - d + 1), (n / d).cast("int"))), F.lit(1), alt) == full_alt
    units = F.filter(divisors, makes)
    return F.when(alt < ref, n).when((alt > ref) & (ref > 0) & (F.size(units) > 0), F.array_max(units))


def vrs_state(full_ref: Column, full_alt: Column, seed: Column) -> Column:
    """The canonical JSON of an allele's state: literal bases, or a length and a repeated unit where the reference has the bases."""
    unit = F.when(seed.isNotNull(), repeat_unit(full_ref, full_alt, seed))
    same = (full_ref == full_alt) & (full_ref != "")
    length = lambda n, u: F.format_string('{"length":%d,"repeatSubunitLength":%d,"type":"ReferenceLengthExpression"}', n, u)
    literal = F.concat(F.lit('{"sequence":"'), full_alt, F.lit('","type":"LiteralSequenceExpression"}'))
    return F.when(same, length(F.length(full_ref), F.length(full_ref))).when(unit.isNotNull(), length(F.length(full_alt), unit)).otherwise(literal)


def vrs_location(accession: Column, start: Column, end: Column) -> Column:
    """The canonical JSON of a sequence location."""
    return F.format_string('{"end":%d,"sequenceReference":{"refgetAccession":"%s","type":"SequenceReference"},"start":%d,"type":"SequenceLocation"}', end, accession, start)


def with_vrs(normal: DataFrame, accessions: DataFrame) -> DataFrame:
    """Rows of normalised() with accession, vrs_location_id, vrs_state and vrs_id."""
    of = accessions.select(F.col("name").alias("name_"), "accession")
    rows = normal.join(of, normal["name"] == F.col("name_"), "left").drop("name_")
    state = vrs_state(F.col("full_ref"), F.col("full_alt"), F.col("seed"))
    known = F.col("accession").isNotNull() & F.col("start").isNotNull()
    location = F.when(known, short_digest(vrs_location(F.col("accession"), F.col("start"), F.col("end"))))
    allele = F.concat(F.lit('{"location":"'), location, F.lit('","state":'), state, F.lit(',"type":"Allele"}'))
    return rows.select("*", F.concat(F.lit("ga4gh:SL."), location).alias("vrs_location_id"), F.when(known, state).alias("vrs_state"), F.concat(F.lit("ga4gh:VA."), short_digest(allele)).alias("vrs_id"))


def spdi(accession: Column, start: Column, full_ref: Column, full_alt: Column) -> Column:
    """accession:start:deleted:inserted with the fully justified allele, so equal variants have equal texts."""
    return F.concat_ws(":", accession, start.cast("string"), full_ref, full_alt)


def left_aligned(start: Column, full_ref: Column, full_alt: Column, seed: Column) -> Column:
    """position (from 1), ref and alt as far to the left as they go; `-` for no bases. seed: the inserted or deleted bases, null for anything else."""
    n, m = F.length(full_ref), F.length(full_alt)
    # What is left of a justified insertion or deletion at its left end is the difference in length.
    part = lambda c, size: F.when(seed.isNull(), c).otherwise(F.substr(c, F.lit(1), size - F.least(n, m)))
    dash = lambda c: F.when(c == "", "-").otherwise(c)
    return F.struct((start + 1).alias("position"), dash(part(full_ref, n)).alias("ref"), dash(part(full_alt, m)).alias("alt"))


def with_genome_base(rows: DataFrame, sequence: DataFrame, size: int = CHUNK) -> DataFrame:
    """rows (with name and position from 1) with genome_base: the base at that place, null where there is none."""
    chunks = sequence.select(F.col("name").alias("name_"), F.col("chunk").alias("chunk_"), F.col("bases").alias("bases_"))
    at = F.col("position").cast("long") - 1
    joined = rows.join(chunks, (rows["name"] == F.col("name_")) & (F.floor(at / size) == F.col("chunk_")), "left")
    base = F.substr("bases_", (at - F.col("chunk_") * size + 1).cast("int"), F.lit(1))
    return joined.select(*[rows[c] for c in rows.columns if c != "genome_base"], F.when(base != "", base).alias("genome_base"))


def genomic_hgvs(accession: Column, normal: DataFrame) -> Column:
    """The genomic expression: shifted to the right end of a repeat; a copy of the bases before it is a duplication."""
    c = {name: normal[name] for name in ("start", "end", "full_ref", "full_alt", "left_shift", "right_shift", "seed")}
    n = F.length(c["seed"])
    turn = F.pmod(c["right_shift"], n).cast("int")
    turned = F.concat(F.substr(c["seed"], turn + 1), F.substr(c["seed"], F.lit(1), turn))
    number = lambda x: x.cast("string")
    span = lambda a, b: F.when(a == b, number(a)).otherwise(F.concat(number(a), F.lit("_"), number(b)))
    deleted, inserted = F.length(c["full_alt"]) < F.length(c["full_ref"]), F.length(c["full_alt"]) > F.length(c["full_ref"])
    copied = inserted & (c["left_shift"] + c["right_shift"] >= n)
    what = (
        F.when(c["full_ref"] == c["full_alt"], F.concat(span(c["start"] + 1, F.greatest(c["end"], c["start"] + 1)), F.lit("=")))
        .when(c["seed"].isNull() & (F.length(c["full_ref"]) == 1) & (F.length(c["full_alt"]) == 1), F.concat(number(c["end"]), c["full_ref"], F.lit(">"), c["full_alt"]))
        .when(c["seed"].isNull(), F.concat(span(c["start"] + 1, c["end"]), F.lit("delins"), c["full_alt"]))
        .when(deleted, F.concat(span(c["end"] - n + 1, c["end"]), F.lit("del")))
        .when(copied, F.concat(span(c["end"] - n + 1, c["end"]), F.lit("dup")))
        .otherwise(F.concat(number(c["end"]), F.lit("_"), number(c["end"] + 1), F.lit("ins"), turned))
    )
    return F.concat(accession, F.lit(":g."), what)
