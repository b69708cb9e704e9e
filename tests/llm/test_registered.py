"""The registered queries on a small odd table, against plain versions of what they return."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandloom.llm.queries import QUERIES
from strandloom.llm.tokens import tokenizer_path

BASE = [(1, "one two, three " * 9, "en", "a"), (2, None, "en", "a"), (7, "again and again " * 1500, "en", "b"), (None, "no id", None, None), (5, "", "de", "c"), (10, "<|endoftext|> Ünï 3 <|startoftext|>x", "de", "a"), (11, "123 !?", "en", None), (7, "der die das und nicht", "de", "b")]
ROWS = [*BASE, BASE[0], *[(100 + k, f"the {k} of an english text and {k % 7} more", "en", "b") for k in range(60)], *[(200 + k, f"der {k} eines deutschen Textes und {k % 5} mehr", "de", "c") for k in range(60)]]

LABELS = [(1, 1, 0), (1, 1, None), (2, None, 1), (7, 1, 1), (None, 1, 1), (105, 1, 0), (230, 0, 1), (99999, 1, 1)]
VECTORS = [(k, [float(k % 7), float(k * k % 11) / 4, float(k % 3) - 1], 0) for k in range(40)] + [(3, [3.0, 2.25, -1.0], 1), (None, [1.0, 0.5, 0.25], 1), (50, None, 1), (51, [None, 1.0, 1.0], 1), (52, [float("nan"), 1.0, 1.0], 1), (53, [1.0, float("inf"), 1.0], 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "mine") for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, size string")
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, component int").repartition(3).write.parquet(f"{where}/embeddings.parquet")
    return str(where)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def run(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_op1(spark, folder):
    rows = run(spark, "op1_sharding", folder)
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, crc(t)) for i, t, _, _ in ROWS)
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_op2(spark, folder, library):
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    rows = sorted(run(spark, "op2_token_files", folder), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((i, len(ids(t)) // 4, zlib.crc32(ids(t))) for i, t, _, _ in ROWS)
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows[:-1])]).tolist()


def test_op3(spark, folder, library):
    pieces = Counter()
    for i, t, _, _ in ROWS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces.update((i, k, 4096 * k, len(ids[4096 * k :][:4096]), zlib.crc32(ids[4096 * k :][:4096].tobytes())) for k in range(-(-len(ids) // 4096)))
    rows = run(spark, "op3_packing", folder)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(ends.values()) // 4096)


def test_op5(spark, folder):
    rows = run(spark, "op5_mixing", folder)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, words(t)) for i, t, _, _ in ROWS)
    total = {s: sum(words(t) for _, t, _, of in ROWS if of == s) for s in ("a", "b", "c", None)}
    of = {(i, words(t)): s for i, t, _, s in ROWS}
    for s in total:
        mine = [r for r in rows if of[r["doc_id"], r["size"]] == s]
        assert {r["source_size"] for r in mine} == {total[s]} and len({r["target"] for r in mine}) == 1
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2 + 1e-6
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in rows)
    assert Counter(map(str, rows)) == Counter(map(str, run(spark, "op5_mixing", folder)))


def test_op7(spark, folder):
    rows = run(spark, "op7_language", folder)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert Counter((r["doc_id"], r["held_out"]) for r in rows) == Counter((i, held(i)) for i, _, _, _ in ROWS)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in rows)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {2, 5, 11}


def test_op9(spark, folder):
    rows = run(spark, "op9_substring", folder)
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    for r in rows:
        old = next(t for i, t, _, _ in ROWS if i == r["doc_id"] and len((t or "").encode()) >= len((r["text"] or "").encode()) + r["removed_bytes"] - 8)
        assert (r["text"] is None) == (old is None) and r["removed_bytes"] == sum(s["stop"] - s["start"] for s in r["removed_spans"])


def test_op11(spark, folder):
    from tests.llm.test_filter_audit import by_hand, found

    assert found(QUERIES["op11_filter_audit"](spark, folder)) == by_hand([(i, t, s) for i, t, _, s in ROWS], LABELS)


def test_op12(spark, folder):
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    tokens = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    want = Counter((i, len(ids := tokens.encode_ordinary(t or "")), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())) for i, t, _, _ in ROWS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op12_byte_bpe", folder)) == want


def test_op13(spark, folder):
    rows = run(spark, "op13_whitening", folder)
    whole = [(i, [int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v]) for i, v, _ in VECTORS if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.unique(np.array([v for _, v in whole]), axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in rows) == Counter((i, k, len(x), sum((len(x) * a - s) ** 2 for a, s in zip(v, x.sum(axis=0).tolist(), strict=True))) for i, v in whole for k in (1, 2, 3))
    want = sorted((round(abs(w), 6), k + 1) for i, v in whole for k, w in enumerate((np.array(v) - x.mean(axis=0)) @ axes / np.sqrt(values)))
    assert np.allclose(sorted((abs(r["whitened"]), r["component"]) for r in rows), want, atol=1e-5) and all(r["identity_error"] < 1e-4 for r in rows)
    assert all(abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-4 for r in rows)
