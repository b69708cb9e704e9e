"""The backtracking encoder against merging step by step, and against the library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import byte_bpe
from strandloom.llm.byte_bpe import ByteEncoder, decode, encode, merged

PATTERN = public_tokenizers.PATTERN
FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    import tiktoken

    own = ByteEncoder(public_tokenizers.path(request.param), PATTERN)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids_of(own, texts):
    ids, counts = own.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_every_code_point(both):
    own, library = both
    for low in range(0, 0x110000, 1 << 14):
        texts = [f"a{c} b{c}{c}! {c}x  {c}" for c in map(chr, range(low, low + (1 << 14), 7)) if not "\ud800" <= c <= "\udfff"]
        if texts:
            assert ids_of(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_random_texts(both):
    own, library = both
    rnd = random.Random(3)
    for letters in ("ab", "a", "aàß ", "the in g", "xyz'sll ", "\n\t 1a", "漢字かな", "aeiou tnsrlhd" * 3 + ".,!?\n0123"):
        texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
        assert ids_of(own, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_any_text(texts):
    own = byte_bpe.encoder(public_tokenizers.path(FILES[0]), PATTERN)
    ids, counts = own.encode(texts)
    raw, _ = own.decode(ids)
    assert raw.tobytes() == "".join(texts).encode()
    assert len(counts) == len(texts)


@pytest.mark.parametrize("seed", range(6))
def test_small_vocabularies_against_merging(tmp_path, seed):
    """Vocabularies of random merges over three letters, where backtracking is common."""
    import base64

    rnd = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    while len(tokens) < 300:
        new = rnd.choice(tokens[97:100] + tokens[256:]) + rnd.choice(tokens[97:100] + tokens[256:])
        # A step of real merging: the pair must be what merging leaves of its bytes.
        if new not in tokens and len(new) < 9 and len(merged(new, {t: k for k, t in enumerate(tokens)})) == 2:
            tokens.append(new)
    path = tmp_path / "small"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    own = ByteEncoder(str(path), r"\S+|\s+")
    for _ in range(1500):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 40)))
        assert [own.token[i] for i in own.encode_match(text)] == merged(text.encode(), own.ranks), text


def test_full_dictionaries(both, monkeypatch):
    own, library = both
    small = ByteEncoder(public_tokenizers.path(FILES[0]), PATTERN, most=20) if own.ranks == byte_bpe.read_ranks(public_tokenizers.path(FILES[0])) else own
    monkeypatch.setattr(byte_bpe, "MOST_PAIRS", 30)
    rnd = random.Random(5)
    for _ in range(30):
        texts = [" ".join("".join(rnd.choice("etaoin") for _ in range(rnd.choice([2, 5, 90]))) for _ in range(20)) for _ in range(3)]
        assert ids_of(small, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_matches_take_linear_time(both):
    import time

    own, library = both
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefgh") for _ in range(400_000))
    seconds = []
    for n in (40_000, 400_000):
        began = time.process_time()
        ids = own.encode_match(text[:n])
        seconds.append(time.process_time() - began)
    assert ids[:1000] == library.encode_ordinary(text[:8000])[:1000]
    assert seconds[1] < 40 * max(seconds[0], 0.02)


def test_frames(spark):
    how = (public_tokenizers.path(FILES[0]), PATTERN)
    rows = [(1, "one two", "a"), (2, None, "b"), (3, "", "c"), (None, "x" * 3_000_000, "d"), (1, "one two", "a"), (4, "漢字 <|endoftext|>", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string").repartition(3)
    out = encode(docs, *how)
    assert out.columns == ["doc_id", "text", "ids"]
    back = decode(out.withColumn("Decoded", out["doc_id"]), *how)
    got = sorted(((r["doc_id"], r["text"], bytes(r["decoded"]).decode()) for r in back.collect()), key=str)
    assert got == sorted(((i, t, t or "") for i, t, _ in rows), key=str)
    assert [r["ids"] for r in out.where("text is null").collect()] == [[]]
    nulls = spark.createDataFrame([(None,), ([],), ([40, 40],)], "ids array<int>")
    assert [None if r[0] is None else bytes(r[0]) for r in decode(nulls.coalesce(1), *how).select("decoded").collect()] == [None, b"", b"II"]
    assert encode(docs.limit(0), *how).collect() == []
    with pytest.raises(Exception, match="an id that the vocabulary lacks"):
        decode(spark.createDataFrame([([50256],)], "ids array<int>"), *how).collect()
