"""The operators against brute force and on odd tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import jaccard, language, mixing, quality, rollups, sharding, substring, token_files, topk
from strandloom.llm._shared import new_folder
from strandloom.llm.components import components
from strandloom.llm.tokens import WordEncoder, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, nulls, blanks, long and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (40, 60, 90, 150, 300, 5, 4, 1, 700)]
    passage = prose(rng, 80, 10_000)
    texts = [*base, *base[:4], None, "", "  \n\t ", "x", passage + " " + prose(rng, 60), prose(rng, 50) + "\n" + passage, "A B c D e", "a b C d E"]
    words = base[4].split()
    for k in range(12):
        copy = list(words)
        for _ in range(k // 2):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts.append("\n".join(["the same line of words again and again"] * 12))
    rows = [(k, t, ["en", "fr", None][k % 3], [f"s{k % 4}", None][k % 7 == 0], len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[0], (None, "no id here " + base[2], "en", "s1", 9)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_quality(text):
    words = WORD.findall(text or "")
    n = len(words)
    seen, covered = Counter(tuple(words[i : i + 8]) for i in range(n - 7)), set()
    for i in range(n - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality(docs, empty):
    odd = docs.withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1))
    for r in quality.judge(odd).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute_quality(r["text"]) and (not r["kept"] or not r["base_failed"])
    assert quality.judge(docs).where("kept").count() == sum(r["kept"] for r in quality.judge(docs).collect())
    assert quality.judge(empty).count() == 0


def test_matrix():
    counts, sizes = [5, 0, 17, 3], np.array([6, 6, 13])
    rows = [sharding.matrix_row(counts, sizes, 3, p) for p in range(4)]
    assert [int(r.sum()) for r in rows] == counts and (sum(rows) == sizes).all()
    rng = np.random.default_rng(1)
    big = [sharding.hypergeometric(rng, 3 * 10**9, 10**9, 10_000) for _ in range(50)]
    assert abs(np.mean(big) - 7500) < 40


def test_sharding(docs, empty, corpus):
    for rows_per_block in (3, 1000):
        found = sharding.shard(docs.withColumn("SLOT", F.lit(0)), 5, block_rows=rows_per_block).collect()
        assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((r[0], r[1]) for r in corpus)
        slots = {s: sorted(r["slot"] for r in found if r["shard"] == s) for s in range(5)}
        assert all(v == list(range(len(v))) for v in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(empty, 5).count() == 0


def test_shuffle_is_uniform(spark):
    frame = spark.range(12).repartition(3)
    counts = Counter(r["shard"] for seed in range(40) for r in sharding.shard(frame, 3, seed=seed).where("id = 0").collect())
    assert set(counts) == {0, 1, 2} and min(counts.values()) >= 4


def test_words_make_the_text():
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    odd = ["", None, "  a  b", "it's don't x's. y'", "İstanbul ΣΑΣ Σ", "áb. ć.", "<|endoftext|> x<|startoftext|>y", "A1.5,b..c!!x", "no break　w\x85z", "é. É, ñ.", "👍🏽.ok, 𝒳y", "a\x00b \x1f c\x1cd", "'S. don'T, it'S.", "a, . b", "x" * 5000, "Straße ŉ ǆ ǅ"]
    ids, sizes = encoder.encode(odd)
    at = 0
    for text, n, whole in zip(odd, sizes, encoder.tokenizer.encode_batch([t or "" for t in odd], add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == whole.ids, text
        at += n
    assert at == len(ids)


@pytest.mark.parametrize("high", [1, 2, 256, 70_000, 2**24 + 1, 2**32])
def test_variable_length_coding(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 3, 4, 5, 999):
        x = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        control, data = token_files.encode_ranks(x)
        assert len(control) == -(-n // 4) and (token_files.decode_ranks(control, data, n) == x).all()


def test_token_files(spark, docs, empty, corpus):
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    folder = new_folder(spark, "test-tokens")
    token_files.write_token_files(docs, folder, partitions=3)
    found = token_files.read_token_files(spark, folder).orderBy("start").collect()
    ids_of = lambda t: [*encoder.encode([t])[0].tolist(), 2]
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in corpus), key=lambda i: (i is not None, i or 0))
    assert Counter(bytes(r["ids"]) for r in found) == Counter(np.array(ids_of(r[1]), "<u4").tobytes() for r in corpus)
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += r["n_tokens"]
    other = new_folder(spark, "test-tokens")
    token_files.write_token_files(empty, other, partitions=2)
    assert token_files.read_token_files(spark, other).count() == 0


def test_rollups(spark, docs, empty):
    store = rollups.Rollup(spark, new_folder(spark, "test-rollup"))
    assert store.totals().count() == 0
    assert store.commit("a", rollups.changes(docs, "insert", "words-1"))
    assert not store.commit("a", rollups.changes(docs, "insert", "words-1"))
    whole = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}
    want: dict = {}
    for r in docs.collect():
        n = want.get((r["source"], r["lang"]), (0, 0))
        want[r["source"], r["lang"]] = (n[0] + 1, n[1] + len(WORD.findall(r["text"] or "")))
    assert whole == want
    store.compact()
    assert store.committed() == {"a"} and not store.commit("a", rollups.changes(docs, "insert", "words-1"))
    store.commit("b", rollups.changes(docs.where("lang = 'en'"), "delete", "words-1"))
    store.commit("c", rollups.changes(docs.where("lang = 'fr'"), "revise", "pieces-1", old=("text", "words-1")))
    store.commit("d", rollups.changes(empty, "insert", "words-1"))
    langs = {(r["lang"], r["tokenizer"]) for r in store.totals().collect()}
    assert langs == {("fr", "pieces-1"), (None, "words-1")}
    with pytest.raises(Exception, match="unknown op"):
        store.commit("e", rollups.changes(docs, "upsert", "words-1"))


def test_mixing(docs, empty, corpus):
    rows = mixing.mix(docs.withColumn("Shard", F.lit("mine")), n_shards=4, lanes=2).collect()
    size = {}
    for r in corpus:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    order = [*sorted(s for s in size if s), *([None] if None in size else [])]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and r["copies"] <= 3
        if r["epoch"] is not None:
            taken[r["source"]] += r["size"]
            assert 0 <= r["shard"] < 4
    for s in order:
        assert abs(taken[s] - target[s]) <= max(len(WORD.findall(r[1] or "")) for r in corpus if r[3] == s)
    again = mixing.mix(docs.repartition(7), n_shards=4, lanes=2).collect()
    key = lambda rows: Counter((r["doc_id"], r["text"], r["epoch"], r["shard"]) for r in rows)
    assert key(rows) == key(again)
    assert mixing.mix(empty, n_shards=4).count() == 0


def test_splitting_tree(spark):
    quotas = [7, 0, 30, 256, 1]
    frame = spark.createDataFrame([(k, q) for k, q in enumerate(quotas)], "place long, quota long")
    found = {r["place"]: r["shards"] for r in mixing.splitting_tree(frame, 6, 3).collect()}
    assert [len(found[k]) for k in range(5)] == quotas
    per_shard = Counter(s for v in found.values() for s in v)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and set(per_shard) == set(range(6))
    assert all(v == sorted(v) for v in found.values())


def brute_components(rows):
    table = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(table))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("cell,short", [(4096, 16), (4, 2)])
def test_jaccard(docs, empty, corpus, monkeypatch, cell, short):
    monkeypatch.setattr(jaccard, "CELL_ROWS", cell)
    monkeypatch.setattr(jaccard, "SHORT", short)
    found = jaccard.similar_components(docs).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(corpus)
    assert jaccard.similar_components(empty).count() == 0


def test_tree_bounds():
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**62), 2**62, 300)
    sets = [np.unique(np.concatenate([base[k % 7 :], rng.integers(-(2**62), 2**62, 3 * k)])) for k in range(150)]
    links = jaccard.link_forest(np.arange(150), np.zeros(150, int), sets)
    parent = list(range(150))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    want = [root(k) for k in range(150)]
    parent = list(range(150))
    for a, b in links:
        parent[root(a)] = root(b)
    got = [root(k) for k in range(150)]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {x: found.get(x, x) for x in parent} == {x: root(x) for x in parent}


def test_language(spark, empty):
    rng = random.Random(3)
    words = {"aa": ["kala", "mopa", "tilo"], "bb": ["strunk", "wirx", "gromp"], "cc": ["éta", "ùno", "çri"]}
    make = lambda k: " ".join(rng.choice(words[k]) for _ in range(rng.randrange(3, 40)))
    rows = [(n, make(k), k) for n, k in enumerate(list(words) * 60)] + [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    coder = language.fit(frame, F.col("doc_id") < 120)
    found = {r["doc_id"]: r for r in language.predict(frame.withColumn("score", F.lit("mine")), coder).collect()}
    assert all(found[n]["lang_pred"] == "und" and found[n]["score"] == 0 for n in (900, 901, 902))
    held = [(found[n]["lang_pred"], k) for n, _, k in rows if 120 <= n < 900]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in found.values())
    assert language.fit(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in language.predict(frame, None).collect()} == {"und"}
    one = language.fit(frame.where("lang = 'aa'"), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(frame, one).collect()} == {"aa", "und"}
    assert language.predict(empty, coder).count() == 0


@pytest.mark.parametrize("n", [2, 4, 6, 9, 40])
def test_codewords_are_apart(n):
    codes = language.codewords(n)
    distance = [int((codes[a] != codes[b]).sum()) for a in range(n) for b in range(a)]
    assert min(distance) >= (1 if n == 2 else 2)


def test_substrings(spark, docs, empty, corpus):
    found = substring.dedup_substrings(docs.withColumn("n_copied", F.lit("mine"))).collect()
    assert len(found) == len(corpus)
    by_id = {r["doc_id"]: r for r in found}
    old = {r[0]: r[1] for r in corpus}
    assert by_id[0]["text"] == old[0]  # the first stays
    assert by_id[9]["text"] == "" and by_id[10]["text"] == ""  # exact copies of 0 and 1 are gone
    assert by_id[13]["text"] is None and by_id[14]["text"] == "" and by_id[None]["text"] == next(r[1] for r in corpus if r[0] is None)
    first, second = by_id[17], by_id[18]
    assert first["text"] == old[17] and second["removed_bytes"] > 250  # most of the passage of 80 words
    assert second["text"].startswith(" ".join(old[18].split()[:40]))
    for r in found:
        text = (old[r["doc_id"]] or "").encode()
        cut = b"".join(text[a:b] for a, b in zip([0, *(s["stop"] for s in r["removed_spans"])], [*(s["start"] for s in r["removed_spans"]), len(text)], strict=True))
        assert (r["text"] or "").encode() in (cut, b"")
    assert substring.dedup_substrings(empty).count() == 0


def test_insertions_move_few_chunks():
    rng = random.Random(8)
    text = prose(rng, 600, 50_000)
    whole = set(substring.chunks_of([text.encode()])["digest"].tolist())
    moved = substring.chunks_of([("new words here " + text[:900] + " inserted " + text[900:]).encode()])["digest"].tolist()
    assert len(whole & set(moved)) >= 0.95 * len(whole)


@pytest.mark.parametrize("bucket,block", [(4096, 256), (5, 2)])
def test_top_k(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(topk, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(80, 8)) * rng.lognormal(size=(80, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(200, vectors[3].tolist()), (201, [0.0] * 8), (300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (400, [1.0, 2.0]), (None, [1.0] * 8), (500, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    found = {}
    for r in topk.top_k(frame, F.col("id") % 10 == 0, 7).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(k, np.floor(1024 * np.array(v)).astype(np.int64)) for k, v in rows if k is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, x in good:
        if q % 10:
            continue
        scores = sorted((-int(x @ y), k) for k, y in good if k != q and len(y) == len(x))[:7]
        assert sorted(found.get(q, [])) == [(n + 1, k, -s) for n, (s, k) in enumerate(scores)]
    assert topk.top_k(frame.limit(0), F.col("id") % 10 == 0).count() == 0
