"""The trigram index against scans."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandloom.operators import text_index as X
from strandloom.operators.text_index import NOTHING, grams_of, need_of_literal, need_of_pattern

WORDS = ["alzheimer", "Alpha", "beta", "protein", "Tau", "amyloid", "gene expression", "100%", "a_b", "naïve", "İstanbul", "the end", "x.y", "back\\slash", "tau protein"]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12)))) for k in range(900)]
    rows += [(5, "a second text of id 5 with amyloid"), (None, "amyloid"), (2000, None), (2001, "amyloid " * 5000), (2002, "K is Kelvin, ſ long"), (2003, "line\none\r\nalpha")]
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


@pytest.fixture(scope="module")
def index(texts):
    old, X.BUCKET_ROWS = X.BUCKET_ROWS, 40
    try:
        return X.build(texts, "id", "text")
    finally:
        X.BUCKET_ROWS = old


def rows(df):
    return sorted((r["id"], r["text"]) for r in df.collect())


def test_lists_are_bounded_by_buckets(index):
    assert index.buckets == 22 and index.postings.selectExpr("max(size(ids))").first()[0] < 100


@pytest.mark.parametrize("word", ["amyloid", "AMYLOID", "au pro", "100%", "a_b", "ï", "naïve", "İSTANBUL", "ab", "", "back\\sl", "nowhere", "expression gene", "\nalpha", "s kelvin"])
def test_contains_equals_the_scan(texts, index, word):
    plain = word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    assert rows(index.contains(word)) == rows(texts.where(F.col("id").isNotNull() & F.ilike(F.col("text"), F.lit(f"%{plain}%"))))


@pytest.mark.parametrize("pattern", ["amyl[oi]id", "tau|beta", "(tau|alpha) protein", "gene.*expression", "(alz)?heimer", "pro(te)+in", "^alpha", "the end$", "a.c", "[a-z]{3}", "x\\.y", "\\Qx.y\\E", "am(?=yloid)", "(?<n>tau) protein", "tau (?:protein|beta)", "alpha++", "\\p{L}ta\\b", "(a|b)eta", "zzz+", "(?s)line.one"])
@pytest.mark.parametrize("ignore_case", [False, True])
def test_patterns_equal_the_scan(texts, index, pattern, ignore_case):
    test = F.rlike(F.col("text"), F.lit(f"(?i){pattern}" if ignore_case else pattern))
    assert rows(index.matching(pattern, ignore_case)) == rows(texts.where(F.col("id").isNotNull() & test))


def test_needs():
    assert grams_of(need_of_literal("Abcd")) == {"abc", "bcd"} and need_of_literal("ab") == NOTHING and need_of_literal("éab") == NOTHING
    for loose in ("a.*b", "(abc)?", "abc|d", "[a-z]+", "\\p{L}abc", "abc*+d", "(?u)abc", "(", "a{2}"):
        assert need_of_pattern(loose) == NOTHING, loose
    assert grams_of(need_of_pattern("tau|beta")) == {"tau", "bet", "eta"} and need_of_pattern("tau|beta").kind == "any"
    assert grams_of(need_of_pattern("ab[cd]e")) == {"abc", "bce", "abd", "bde"}
    assert X.rarest(need_of_literal("abcdefghij"), {"abc": 5, "cde": 1}, 2).parts[0].of in {"bcd", "def"}


def test_a_search_reads_its_buckets_only(index):
    plan = index.matching("a second text")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(bucket," in plan or "In(bucket" in plan  # pushed to the scan of the texts
    candidates = index.candidates(need_of_pattern("a second text")).collect()
    assert {r["id"] for r in candidates} == {5}


def test_parts_of_lists_are_put_together(texts, index, monkeypatch):
    """Tiny runs and pieces: a bucket's lists come in many parts, a long text in overlapping ones."""
    monkeypatch.setattr(X, "BUCKET_ROWS", 400)
    cut = X.build(texts.select("id", "text"), "id", "text")
    parts = index.postings.select("gram", "bucket", F.explode("ids").alias("x")).select("gram", "bucket", F.array("x").alias("ids"))
    for pattern in ("amyl[oi]id", "tau|beta", "a second text"):
        assert rows(replace(index, postings=parts).matching(pattern)) == rows(index.matching(pattern))
    whole = lambda df: {r["gram"]: sorted(r["ids"]) for r in df.groupBy("gram").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")).collect()}
    batches = texts.where("id IS NOT NULL AND text IS NOT NULL").orderBy("id").select(F.lit(0).cast("int"), "id", F.lower("text")).toArrow().to_batches()
    plain = {}
    for k, text in ((r["id"], r["t"]) for r in texts.where("id IS NOT NULL AND text IS NOT NULL").select("id", F.lower("text").alias("t")).collect()):
        for j in range(len(text) - 2):
            if text[j : j + 3].isascii():
                plain.setdefault(text[j : j + 3], set()).add(k)
    plain = {g: sorted(k) for g, k in plain.items()}
    assert whole(cut.postings) == plain and whole(index.postings) == plain
    for run, piece in ((7, 50), (1000, 3), (1 << 20, 1 << 20)):
        monkeypatch.setattr(X, "RUN_PAIRS", run)
        monkeypatch.setattr(X, "PIECE_BYTES", piece)
        found = {}
        for b in X._lists(iter(batches)):
            for r in b.to_pylist():
                found.setdefault(r["gram"], set()).update(r["ids"])
        assert {g: sorted(k) for g, k in found.items()} == plain


def test_lists_are_not_shuffled(spark, tmp_path):
    """A build shuffles about the texts, not the trigrams' lists too."""
    rnd = random.Random(4)
    rows = spark.createDataFrame([(k, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(500))) for k in range(3000)], "id long, text string").repartition(3)
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def shuffled():
        bus.waitUntilEmpty()
        return store.executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    rows.write.parquet(f"{tmp_path}/rows")
    own = shuffled() - before
    X.build(spark.read.parquet(f"{tmp_path}/rows"), "id", "text")
    assert 0 < shuffled() - before - own < 3 * 3000 * 500
