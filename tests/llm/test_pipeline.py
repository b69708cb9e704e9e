from __future__ import annotations

import pytest

import corpus_pipeline
from strandloom.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packed_sequences":
            assert docs.columns == columns
        if name in ("quality_rules", "near_duplicates"):
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_stages_take_odd_tables(spark, sf, tmp_path):
    for k, rows in enumerate(([], [(1, None, None, None, None, "x"), (None, "a", "en", "s", 1, None)])):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}-{name}")
            if name == "packed_sequences":
                break
            assert spark.read.parquet(f"{tmp_path}/{k}-{name}").columns == docs.columns


def test_what_stages_decide(spark, tmp_path):
    """Junk goes, of copies and near copies one stays, a passage stays where it came first, sources are taken by their targets, and sequences hold the library's ids."""
    import random
    from collections import Counter

    import numpy as np
    from tokenizers import Tokenizer

    from strandloom.llm.tokens import tokenizer_path

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(4, 8)))
    text = lambda n: " ".join(rnd.choice(["the", "and", "of", "to"]) if k % 3 == 0 else word() for k in range(n))
    first, passage = text(150), text(70)
    near = first.rsplit(" ", 1)[0] + " another"
    rows = [(1, first, "a"), (2, first, "b"), (3, near, "a"), (4, "junk " * 9, "a"), (5, "x # $ % & | " * 40, "b"), (6, f"{text(80)} {passage} {text(60)}", "a"), (7, f"{text(60)} {passage} {text(80)}", "b")]
    rows += [(10 + k, text(120), "abc"[k % 3]) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = lambda name: sorted(r["doc_id"] for r in seen[name])
    assert ids("quality_rules") == [i for i, _, _ in rows if i not in (4, 5)]
    assert ids("near_duplicates") == [i for i, _, _ in rows if i not in (2, 3, 4, 5)]
    texts = {r["doc_id"]: r["text"] for r in seen["repeated_passages"]}
    middle = " ".join(passage.split()[10:60])
    assert sorted(texts) == ids("near_duplicates") and middle in texts[6] and middle not in texts[7] and texts[1] == first and all(texts[i] == t for i, t, _ in rows if i >= 10)
    assert all(r["n_chars"] == len(r["text"]) for r in seen["repeated_passages"])
    sizes = Counter()
    for r in seen["repeated_passages"]:
        sizes[r["source"]] += len(r["text"].split())
    taken, total = Counter(), sum(sizes.values())
    for r in seen["source_mix"]:
        taken[r["source"]] += len(r["text"].split())
    weights = dict(zip(sorted(sizes), (1, 2, 3), strict=True))
    assert all(abs(taken[s] - total * weights[s] / 6) < 400 for s in sizes) and max(Counter(ids("source_mix")).values()) <= 3
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter((r["doc_id"], tuple([*library.encode(r["text"], add_special_tokens=False).ids, 1])) for r in seen["source_mix"])
    packed = Counter((r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in seen["packed_sequences"])
    assert packed == want  # no document is longer than a sequence here
    fill = Counter()
    for r in seen["packed_sequences"]:
        fill[r["sequence_id"]] += len(bytes(r["ids"])) // 4
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = sorted(c[0] for c in cursor.description)
    at = {c[0]: k for k, c in enumerate(cursor.description)}
    want = sorted(repr([r[at[c]] for c in names]) for r in cursor.fetchall())
    found = QUERIES[name](spark, sf)
    assert sorted(found.columns) == names
    assert sorted(repr([r[c] for c in names]) for r in found.collect()) == want
