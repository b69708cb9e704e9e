"""Token counts: a real vocabulary, writers that die, and writers of one name."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.llm import rollups
from strandloom.llm._shared import new_folder
from strandloom.llm.queries import QUERIES
from strandloom.llm.tokens import tokenizer_path

DOCS = [(1, "Hello, world <|endoftext|> again", "en", "a", 30), (2, None, "en", "a", 0), (3, "drei Wörter hier", None, None, 16), (4, "", "de", "b", 1), (4, "x" * 9000, "de", "b", 9000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(store):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}


def test_vocabulary(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for _, t, lang, source, n in DOCS:
        signed = [("words-1", 1, len((t or "").split())), ("word-bpe-49k", 1, pieces(t))]
        signed += [("word-bpe-49k", -1, -pieces(t))] if n % 2 == 0 else []
        signed += [("word-bpe-49k", 1, pieces(t)), ("words-1", -1, -len((t or "").split()))] if lang == "en" else []
        for kind, one, tokens in signed:
            want[source, lang, kind, "docs"] += one
            want[source, lang, kind, "tokens"] += tokens
    found = Counter()
    for r in QUERIES["op4_token_counts"](spark, str(tmp_path)).collect():
        found[r["source"], r["lang"], r["tokenizer"], "docs"] += r["n_docs"]
        found[r["source"], r["lang"], r["tokenizer"], "tokens"] += r["n_tokens"]
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in found.items() if v}


def test_a_writer_that_dies_before_its_marker(spark, docs, monkeypatch):
    store = rollups.Rollup(spark, new_folder(spark, "test-rollup"))
    with monkeypatch.context() as m:
        m.setattr(rollups.Rollup, "_mark", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            store.commit("a", rollups.changes(docs, "insert", "words-1"))
    assert rows_of(store) == {} and store.committed() == set()
    assert store.commit("a", rollups.changes(docs, "insert", "words-1"))
    once = rows_of(store)
    assert sum(n for n, _ in once.values()) == len(DOCS)


def test_a_compaction_that_dies(spark, docs, monkeypatch):
    store = rollups.Rollup(spark, new_folder(spark, "test-rollup"))
    store.commit("a", rollups.changes(docs, "insert", "words-1"))
    store.commit("b", rollups.changes(docs.where(F.col("doc_id") == 1), "delete", "words-1"))
    before = rows_of(store)
    store.compact()  # deletes nothing yet: what it folds stays for readers
    with monkeypatch.context() as m:
        m.setattr(rollups, "delete_path", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            store.compact()
    assert rows_of(store) == before and store.committed() == {"a", "b"} and not store.commit("b", rollups.changes(docs, "delete", "words-1"))
    store.compact()
    assert rows_of(store) == before and store.committed() == {"a", "b"}


def test_two_writers_of_one_name(spark, docs, monkeypatch):
    store = rollups.Rollup(spark, new_folder(spark, "test-rollup"))
    other = rollups.Rollup(spark, store.folder)
    assert store.commit("a", rollups.changes(docs, "insert", "words-1"))
    once = rows_of(store)
    with monkeypatch.context() as m:
        m.setattr(rollups.Rollup, "committed", lambda self: set())  # looked before the first one had its marker
        assert not other.commit("a", rollups.changes(docs, "insert", "words-1"))
    assert rows_of(store) == once


def test_a_commit_during_compaction_counts_once(spark, docs, monkeypatch):
    store = rollups.Rollup(spark, new_folder(spark, "test-rollup"))
    store.commit("a", rollups.changes(docs, "insert", "words-1"))
    marked = rollups.Rollup._mark

    def commit_first(self, name, what):
        if "/snapshots/" in name:
            with monkeypatch.context() as m:
                m.setattr(rollups.Rollup, "_mark", marked)
                assert self.commit("b", rollups.changes(docs, "insert", "words-1"))
        return marked(self, name, what)

    summed = rollups.Rollup._sums

    def commit_between(self, *state):
        out = summed(self, *state)
        self.commit("c", rollups.changes(docs, "insert", "words-1"))
        return out

    once = rows_of(store)
    with monkeypatch.context() as m:
        m.setattr(rollups.Rollup, "_mark", commit_first)
        m.setattr(rollups.Rollup, "_sums", commit_between)
        store.compact()
    three = {k: (3 * n, 3 * t) for k, (n, t) in once.items()}
    assert rows_of(store) == three and store.committed() == {"a", "b", "c"}
    store.compact()
    store.compact()
    assert rows_of(store) == three and len(store._names("snapshots")) == 2 and not store._names("batches")


def test_readers_and_writers_across_compactions(spark, docs):
    from concurrent.futures import ThreadPoolExecutor

    store = rollups.Rollup(spark, new_folder(spark, "test-rollup"))
    store.commit("a", rollups.changes(docs, "insert", "words-1"))
    before, once = store.totals(), rows_of(store)
    store.compact()
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in before.collect()} == once
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda _: rollups.Rollup(spark, store.folder).commit("b", rollups.changes(docs, "insert", "words-1")), range(4)))
    assert sum(won) == 1 and rows_of(store) == {k: (2 * n, 2 * t) for k, (n, t) in once.items()}
    with ThreadPoolExecutor(8) as pool:
        marks = list(pool.map(lambda k: store._mark(f"{store.folder}/batches/one.done", str(k)), range(24)))
    assert sum(marks) == 1
