"""Language prediction against a plain version, and its held-out accuracy on documents."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import language
from strandloom.llm.queries import QUERIES


def plain(coder, text):
    """Loss-weighted decoding of one text, n-gram by n-gram."""
    raw = bytes(language._FOLD[np.frombuffer(text.encode() + b"  ", np.uint8)])
    n, losses = len(raw) - 2, []
    values = [0.0] * coder.weights.shape[1]
    for k in range(n):
        for width, salt in ((1, 1 << 24), (2, 1 << 25), (3, 1 << 26)):
            number = int.from_bytes(raw[k : k + width], "big")
            bucket = ((number + salt) * 2654435761 % 2**32) >> (32 - language.BITS)
            for bit in range(len(values)):
                values[bit] += float(coder.weights[bucket, bit])
    values = [v / (3 * n) + float(b) for v, b in zip(values, coder.bias, strict=True)]
    for code in coder.codes:
        losses.append(sum(t * math.log1p(math.exp(-v * c)) for v, c, t in zip(values, code, coder.trust, strict=True)))
    share = [math.exp(min(losses) - x) for x in losses]
    best = losses.index(min(losses))
    return coder.languages[best], share[best] / sum(share)


def test_decoding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    coder = language.fit(docs, F.col("doc_id") % 3 == 0)
    rows = language.predict(docs.where(F.octet_length("text") < 3000), coder).limit(60).collect()
    for r in rows:
        if r["lang_pred"] != "und":
            name, score = plain(coder, r["text"])
            assert name == r["lang_pred"] and abs(score - r["score"]) < 1e-4


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    found = QUERIES["op7_language"](spark, sf).where("held_out").join(docs, "doc_id").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}{3}"))
    n, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 20 and right >= 0.95 * n


def test_bounds_of_the_fit(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 12)
    monkeypatch.setattr(language, "SAMPLE_BYTES", 40)
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    rows = [(k, f"text {k} " * (1 + 20 * (k % 2)), f"l{k % 5}") for k in range(200)] + [(900 + k, "rare", "zz") for k in range(2)]
    found = language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", F.lit(True))
    assert len(found) == 12 and {y for _, y in found} == {"l0", "l1", "l2"} and max(len(t) for t, _ in found) <= 40
