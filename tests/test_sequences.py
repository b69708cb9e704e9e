"""Sequences in chunks, and variants over them, against plain versions on whole strings."""

from __future__ import annotations

import hashlib
import random
from base64 import urlsafe_b64encode

import pytest
from pyspark.sql import functions as F

from strandloom.operators import sequences as S
from strandloom.sources.sequences import in_chunks, read_fasta

SIZE = 7


def repetitive(rnd, n):
    out = ""
    while len(out) < n:
        out += rnd.choice(["ACGT", "A" * rnd.randint(1, 20), "CA" * rnd.randint(1, 15), "GATTACA", "N", rnd.choice("ACGT")])
    return out[:n]


@pytest.fixture(scope="module")
def genome():
    rnd = random.Random(11)
    return {"1": repetitive(rnd, 400), "2": repetitive(rnd, 90), "X": "A" * 60 + "C", "short": "AC"}


@pytest.fixture(scope="module")
def sequence(spark, genome):
    pieces = [(n, k, s[k : k + 10]) for n, s in genome.items() for k in range(0, len(s), 10)]
    return in_chunks(spark.createDataFrame(pieces, "name string, start long, bases string"), SIZE)


def trim(ref, alt):
    """Offset of the place and alleles without common suffix and prefix."""
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    k = 0
    while k < min(len(ref), len(alt)) and ref[k] == alt[k]:
        k += 1
    return k, ref[k:], alt[k:]


def justify(sequence, position, ref, alt):
    """start, end, ref, alt and shifts of the fully justified allele, by moving one base at a time."""
    k, ref, alt = trim(ref, alt)
    start = position - 1 + k
    end = start + len(ref)
    if bool(ref) == bool(alt):
        return start, end, ref, alt, 0, 0
    seed = ref or alt
    left = right = 0
    while start - left > 0 and sequence[start - left - 1] == seed[len(seed) - 1 - left % len(seed)] != "N":
        left += 1
    while end + right < len(sequence) and sequence[end + right] == seed[right % len(seed)] != "N":
        right += 1
    head, tail = sequence[start - left : start], sequence[end : end + right]
    return start - left, end + right, head + ref + tail, head + alt + tail, left, right


def random_variants(genome, n=600, seed=5):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        name = rnd.choice(list(genome))
        s = genome[name]
        at = rnd.randrange(len(s))
        ref = s[at : at + rnd.choice([0, 1, 1, 2, 3, 9])]
        alt = rnd.choice(["", "A", "C", "CA", "ACGT", s[at : at + 4], s[max(0, at - 3) : at], ref, ref + s[at + len(ref) : at + len(ref) + 2], ref[:1] + rnd.choice("ACGT")])
        out.append((k, name, at + 1, ref or rnd.choice(["", "-", None]), alt or rnd.choice(["", "-"])))
    return out


def plain(a):
    return "" if a in (None, "-") else a


COLUMNS = "id long, name string, position long, ref string, alt string"


def test_fasta(spark, genome, tmp_path):
    texts = {"a.fa": [("1", 60), ("2", 60)], "b.fa": [("X", 13), ("short", 1)]}
    for file, parts in texts.items():
        (tmp_path / file).write_text("".join(f">{n} about it\n" + "\n".join(genome[n][k : k + w].lower() for k in range(0, len(genome[n]), w)) + "\n\n" for n, w in parts))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")  # many splits for a file
    try:
        rows = read_fasta(spark, str(tmp_path), SIZE).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(len(r["bases"]) == SIZE or r["chunk"] == (len(genome[r["name"]]) - 1) // SIZE for r in rows)
    found = {n: "".join(r["bases"] for r in sorted((r for r in rows if r["name"] == n), key=lambda r: r["chunk"])) for n in genome}
    assert found == genome


def test_fasta_with_one_name_twice(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGTACGTAC\n>x\nACGTACG\n")
    with pytest.raises(Exception, match="two sequences are named x"):
        read_fasta(spark, f"{tmp_path}/a.fa", SIZE).collect()


def test_normalised_against_one_base_at_a_time(spark, genome, sequence):
    rows = random_variants(genome)
    odd = [(9000, None, 3, "A", ""), (9001, "1", None, "A", ""), (9002, "none", 3, "A", ""), (9003, "X", 1, "A", "")]
    found = {r["id"]: r for r in S.normalised(spark.createDataFrame(rows + odd, COLUMNS), sequence, SIZE).collect()}
    assert len(found) == len(rows) + len(odd)
    for k, name, position, ref, alt in rows:
        r = found[k]
        assert (r["start"], r["end"], r["full_ref"], r["full_alt"], r["left_shift"], r["right_shift"]) == justify(genome[name], position, plain(ref), plain(alt)), rows[k]
    assert found[9000]["full_ref"] is None and found[9001]["start"] is None and found[9003]["end"] == 60
    assert (found[9002]["start"], found[9002]["end"]) == (2, 3)


def test_equal_variants_have_equal_forms(spark, genome, sequence):
    """All ways to write a deletion of CA in a repeat of it agree."""
    s = genome["1"]
    at = s.index("CACACACA")
    ways = [(k, "1", at + 1 + 2 * k, "CA", "") for k in range(4)] + [(9, "1", at + 1, "CAC", "C")]
    rows = S.normalised(spark.createDataFrame(ways, COLUMNS), sequence, SIZE).select("start", "end", "full_ref", "full_alt").distinct().collect()
    assert len(rows) == 1


def test_validated(spark, genome, sequence):
    rows = [(1, "1", 5, genome["1"][4:40], "A"), (2, "1", 5, genome["1"][4:39] + "#", "A"), (3, "1", 399, genome["1"][398:] + "A", "A"), (4, "9", 1, "A", "C"), (5, "2", 4, None, "A"), (6, None, 4, "A", "A"), (7, "1", 0, "A", "C")]
    found = {r["id"]: r["ref_matches"] for r in S.validated(spark.createDataFrame(rows, COLUMNS), sequence, SIZE).collect()}
    assert found == {1: True, 2: False, 3: None, 4: None, 5: True, 6: None, 7: None}


def test_published_identifiers(spark):
    """An identifier that the specification prints: the T allele at 44908821 of chromosome 19."""
    row = spark.range(1).select(S.vrs_location(F.lit("SQ.IIB53T8CNeJJdUqzn9V_JnRtQadwWCbl"), F.lit(44908821), F.lit(44908822)).alias("l"))
    location = row.select(S.short_digest(F.col("l"))).first()[0]
    assert location == "wIlaGykfwHIpPY2Fcxtbx4TINbbODFVz"
    allele = '{"location":"' + location + '","state":{"sequence":"T","type":"LiteralSequenceExpression"},"type":"Allele"}'
    assert spark.range(1).select(S.short_digest(F.lit(allele))).first()[0] == "0AePZIWZUNsUlQTamyLrjm2HWUw2opLt"


def state_by_hand(ref, alt, seed):
    if ref == alt and ref:
        return {"length": len(ref), "repeatSubunitLength": len(ref), "type": "ReferenceLengthExpression"}
    if seed is not None and len(alt) < len(ref):
        return {"length": len(alt), "repeatSubunitLength": len(seed), "type": "ReferenceLengthExpression"}
    if seed is not None and len(alt) > len(ref):
        for d in range(len(seed), 0, -1):
            unit = ref[len(ref) - d :] if 0 < d <= len(ref) else ""
            if unit and len(seed) % d == 0 and all(alt[i] == unit[(i - len(ref)) % d] for i in range(len(ref), len(alt))):
                return {"length": len(alt), "repeatSubunitLength": d, "type": "ReferenceLengthExpression"}
    return {"sequence": alt, "type": "LiteralSequenceExpression"}


def test_identifiers(spark, genome, sequence):
    import json

    accession = {n: "SQ." + urlsafe_b64encode(hashlib.sha512(s.encode()).digest()[:24]).decode() for n, s in genome.items()}
    accessions = S.sequence_accessions(sequence)
    assert {r["name"]: (r["accession"], r["length"]) for r in accessions.collect()} == {n: (accession[n], len(s)) for n, s in genome.items()}
    rows = random_variants(genome, 300, 8)
    normal = S.normalised(spark.createDataFrame(rows, COLUMNS), sequence, SIZE)
    found = {r["id"]: r for r in S.with_vrs(normal, accessions).collect()}
    text = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    digest = lambda x: urlsafe_b64encode(hashlib.sha512(text(x).encode()).digest()[:24]).decode()
    for k, name, position, ref, alt in rows:
        start, end, full_ref, full_alt, _, _ = justify(genome[name], position, plain(ref), plain(alt))
        _, r, a = trim(plain(ref), plain(alt))
        location = digest({"type": "SequenceLocation", "sequenceReference": {"type": "SequenceReference", "refgetAccession": accession[name]}, "start": start, "end": end})
        state = state_by_hand(full_ref, full_alt, (r or a) if bool(r) != bool(a) else None)
        assert found[k]["vrs_location_id"] == f"ga4gh:SL.{location}" and found[k]["vrs_state"] == text(state), rows[k]
        assert found[k]["vrs_id"] == "ga4gh:VA." + digest({"location": location, "state": state, "type": "Allele"})


def applied(sequence, start, ref, alt):
    assert sequence[start : start + len(ref)] == ref
    return sequence[:start] + alt + sequence[start + len(ref) :]


def test_texts_describe_the_same_change(spark, genome, sequence):
    """SPDI, left-aligned alleles and genomic expressions, read back, give the changed sequence of the variant as it came."""
    import re

    rows = random_variants(genome, 400, 3)
    normal = S.normalised(spark.createDataFrame(rows, COLUMNS), sequence, SIZE)
    left = S.left_aligned(*map(F.col, ("start", "full_ref", "full_alt", "seed")))
    out = normal.select("id", S.spdi(F.col("name"), F.col("start"), F.col("full_ref"), F.col("full_alt")).alias("spdi"), left.alias("left"), S.genomic_hgvs(F.col("name"), normal).alias("hgvs"))
    kinds = set()
    for r in out.collect():
        _, name, position, ref, alt = rows[r["id"]]
        s = genome[name]
        want = applied(s, position - 1, plain(ref), plain(alt))
        n, start, deleted, inserted = r["spdi"].split(":")
        assert n == name and applied(s, int(start), deleted, inserted) == want
        assert applied(s, r["left"]["position"] - 1, plain(r["left"]["ref"]), plain(r["left"]["alt"])) == want
        what = r["hgvs"].split(":g.")[1]
        m = re.fullmatch(r"(\d+)(?:_(\d+))?(=|del|dup|ins|delins|[ACGTN]>)([ACGTN]*)", what)
        low, high, kind, bases = int(m[1]), int(m[2] or m[1]), m[3], m[4]
        kinds.add(kind if ">" not in kind else ">")
        if kind == "ins":
            assert high == low + 1 and applied(s, low, "", bases) == want
        else:
            new = {"=": s[low - 1 : high], "del": "", "dup": s[low - 1 : high] * 2}.get(kind, bases)
            assert kind == "=" or s[: low - 1] + new + s[high:] == want, (rows[r["id"]], what)
    assert kinds == {"=", "del", "dup", "ins", "delins", ">"}


def test_genome_base(spark, genome, sequence):
    rows = [(k, n, k + 1) for n in ("2", "short") for k in range(95)] + [(500, "none", 1), (501, "2", None), (502, None, 1), (503, "2", 0)]
    found = S.with_genome_base(spark.createDataFrame(rows, "id long, name string, position long"), sequence, SIZE)
    for r in found.collect():
        s = genome.get(r["name"], "")
        assert r["genome_base"] == (s[r["position"] - 1] if r["position"] and 0 < r["position"] <= len(s) else None)
