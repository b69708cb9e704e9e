"""The packed output holds the ids of every sequence."""

from __future__ import annotations

import zlib
from collections import Counter
from pathlib import Path

import numpy as np

import corpus_pipeline
from strandloom.llm._shared import shared_root
from strandloom.llm.queries import QUERIES
from strandloom.llm.tokens import WordEncoder, tokenizer_path

ROWS = [(1, "one two, three", "en", "a", 14), (2, None, "en", "a", 0), (2, "again " * 5000, "en", "b", 30000), (None, "no id", None, None, 5)]


def ids_of_documents(rows):
    """Ids of each document from its pieces, which must fill their sequences without gaps."""
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    found = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        found.setdefault((r["doc_id"], r["length"] == 1 and r["piece"] == 0), []).append(bytes(r["ids"]))
    return Counter((k[0], b"".join(v)) for k, v in found.items())


def wanted():
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    return Counter((r[0], np.array([*encoder.encode([r[1]])[0].tolist(), 1], "<u4").tobytes()) for r in ROWS)


def test_ids(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert ids_of_documents(corpus_pipeline.packed_sequences(spark, docs, str(tmp_path)).collect()) == wanted()
    root = Path(shared_root(spark).removeprefix("file://")) / "strandloom"
    before = set(root.glob("packed-*"))
    digests = QUERIES["op3_packing"](spark, str(tmp_path)).collect()
    (folder,) = set(root.glob("packed-*")) - before
    packed = spark.read.parquet(str(folder)).collect()
    assert ids_of_documents(packed) == wanted()
    key = lambda rows: Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")) for r in rows)
    assert key(digests) == key(packed)
