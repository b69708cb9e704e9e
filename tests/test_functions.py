from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from strandloom.functions import regions as R
from strandloom.functions import strings as S
from strandloom.functions import variants as V
from strandloom.functions.patterns import PATTERNS
from strandloom.operators import filters, metadata, paging, rag


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,ok", [("1p36", True), ("chr1p36.33", True), ("Xq28", True), ("Yp11.2", True), ("22q11.21-q11.23", True), ("7p", False), ("chrZp1", False), ("1-36", False), ("q28", False)])
def test_cytobands(spark, text, ok):
    assert bool(re.match(PATTERNS["cytogenic_location"], text)) is ok
    assert one(spark, F.rlike(F.lit(text), F.lit(PATTERNS["cytogenic_location"]))) is ok


def test_filter_language():
    found = filters.parse("datasource eq encode and feature neq histone modification")
    assert [(t.field, t.op, t.value) for t in found] == [("datasource", "eq", "encode"), ("feature", "neq", "histone modification")]
    assert filters.parse("a not like b and c")[0].value == "b and c"
    for bad in ("a is b", "a eq b1", "", "eq b"):
        with pytest.raises(ValueError):
            filters.parse(bad)
    with pytest.raises(ValueError):
        filters.condition("nosuch eq x", {"lang": "lang"})


def test_filter_drops_nulls(spark):
    rows = spark.createDataFrame([("en",), ("de",), (None,)], "lang string")
    assert rows.where(filters.condition("lang neq en", {"lang": "lang"})).count() == 1


def test_neg_log10():
    assert filters.neg_log10("3e-400") == 400
    assert abs(filters.neg_log10(5e-8) - 7.30103) < 1e-5
    with pytest.raises(ValueError):
        filters.pvalue_at_most(F.lit(1.0), 0.5)


def test_pages():
    assert paging.total_pages(0) == 1
    assert paging.total_pages(5000) == 1
    assert paging.total_pages(5001) == 2
    with pytest.raises(ValueError):
        paging.total_pages(5000 * 101)
    with pytest.raises(ValueError):
        paging.check_format("IDS", "BED")


@pytest.mark.parametrize("ref,alt,kind,length", [("A", "G", "SNV", 1), ("AC", "GT", "MNV", 2), ("A", "AGG", "SHORT_INS", 2), ("AGG", "A", "SHORT_DEL", 2), ("AG", "ATTT", "SHORT_INDEL", 2), ("A", "A" * 60, "INS", 59)])
def test_variant_class(spark, ref, alt, kind, length):
    assert one(spark, V.variant_class(F.lit(ref), F.lit(alt))) == kind
    assert one(spark, V.variant_length(F.lit(ref), F.lit(alt))) == length


@pytest.mark.parametrize("ref,alt,out", [("CAG", "CAT", ("G", "T")), ("CAG", "C", ("AG", "-")), ("A", "AT", ("-", "T")), ("GAT", "GCT", ("A", "C"))])
def test_normalised_alleles(spark, ref, alt, out):
    got = one(spark, V.normalised_alleles(F.lit(ref), F.lit(alt)))
    assert (got["ref"], got["alt"]) == out


def test_primary_keys(spark):
    key = lambda r, a: one(spark, V.primary_key(F.lit("chr1"), F.lit(100), F.lit(r), F.lit(a), F.lit("SQ.x")))
    assert key("A", "G") == "1:100:A:G"
    assert re.match(r"^INS_CHR1_[0-9A-F]{8}$", key("A", "A" * 80))


def test_strings(spark):
    assert one(spark, S.info_string(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit(None).cast("string")))) == "a=.;b=2"
    assert one(spark, S.parse_info(F.lit("a=1=2;flag"))) == {"a": "1=2", "flag": "true"}
    assert one(spark, S.parse_info(F.lit("."))) is None
    assert one(spark, S.jaccard_words(F.lit(""), F.lit(" "))) == 0.0
    assert one(spark, S.is_balanced(F.lit("(a(b)c)"))) and not one(spark, S.is_balanced(F.lit(")(")))
    assert one(spark, S.to_number(F.lit("7.0"))) == 7 and one(spark, S.to_number(F.lit("nan"))) is None
    assert one(spark, S.camel_case(F.lit("ab_cd_ef"))) == "abCdEf"
    assert one(spark, S.sanitise(F.lit("<a&b>"))) == "&lt;a&amp;b&gt;"
    assert one(spark, S.chunked(F.array(*map(F.lit, range(5))), 2)) == [[0, 1], [2, 3], [4]]
    assert one(spark, S.int_to_alpha(F.lit(3))) == "C"


def test_regions(spark):
    assert one(spark, R.chromosome(F.lit("mt"))) == "chrM" and one(spark, R.chromosome(F.lit("chr30"))) is None
    got = one(spark, R.parse_region(F.lit("X:10-20")))
    assert (got["chromosome"], got["start"], got["end"]) == ("chrX", 10, 20)
    assert one(spark, R.parse_region(F.lit("nonsense"))) is None
    assert one(spark, R.is_ancestor(F.lit("chr1.L1.B1"), F.lit("chr1.L1.B1.L2.B2")))
    assert not one(spark, R.is_ancestor(F.lit("chr1.L1.B1"), F.lit("chr1.L1.B12")))


def test_templates(spark):
    assert metadata.clean_key("#Cell Type(s)") == "cell_types"
    assert one(spark, metadata.clean_value(F.lit("Unknown"))) is None
    assert one(spark, metadata.biosample_type(F.lit("Primary tissue"))) == "tissue"
    assert one(spark, metadata.internal_url(F.lit("wget https://host/x/DATA/f.bed"), "https://new", "DATA")) == "https://new/f.bed"


def test_chunks(spark):
    text = "One two. " * 10 + "Last one here!"
    got = one(spark, rag.chunks(rag.sentences(F.lit(text)), 30))
    assert all(len(c) <= 30 for c in got) and " ".join(got) == text


def test_digests_against_python(spark):
    import hashlib
    import uuid

    names = ["track_chr1.bed", "track_chr22.bed", "", "other é", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    for r in rows.select("name", S.blake2b(F.col("name")).alias("b"), S.stable_uuid(F.col("name")).alias("u"), metadata.shard_key(F.col("name")).alias("k")).collect():
        n = r["name"]
        if n is None:
            assert r["b"] is None and r["u"] is None and r["k"] is None
            continue
        assert r["b"] == hashlib.blake2b(n.encode(), digest_size=20).hexdigest()
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, hashlib.sha256(n.encode()).hexdigest()))
        assert r["k"] == "SHARD_GROUP_" + hashlib.sha512(re.sub(r"chr(\d{1,2}|[XYM]|MT)", "_", n).encode()).hexdigest()[:6].upper()


def test_number_formats_round_as_printf(spark):
    values = [198500.0, 65450.0, 9725.0, -9725.0, 0.125, 2.675, 1.005, 70368744177664.375, 1e22, 1e-310, -0.0, 0.00025, 0.00015, float("inf"), float("nan"), None]
    frame = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v double")
    found = frame.select(S.sci_notation(F.col("v")), S.fixed(F.col("v")), S.sci_notation(F.col("v"), 0)).orderBy("n").collect()
    assert [tuple(r) for r in found] == [(None,) * 3 if v is None else (f"{v:.2e}", f"{v:.2f}", f"{v:.0e}") for v in values]
    assert [one(spark, S.frequency_format(F.lit(v))) for v in (0.0, 0.00025, 0.000125)] == ["0", f"{0.00025:.1e}", f"{0.000125:.1e}"]
