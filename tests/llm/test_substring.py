"""Substring dedup against a plain version, and a text of more chunks than 2^20."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from strandloom.llm import substring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_chunks(text):
    """Chunks as (words, first byte, last byte), one word after another."""
    out, start, words = [], None, []
    for m in WORD.finditer(text):
        if start is not None and (m.end() - start) // substring.MAX_BYTES != (last - start) // substring.MAX_BYTES:
            out.append((tuple(words), start, last))
            start, words = None, []
        if start is None:
            start = m.start()
        words.append(m.group())
        last = m.end()
        window = (b" " * substring.LOOK_BACK + text[: m.end()])[-substring.LOOK_BACK :]
        value = 0
        for byte in window:
            value = (2 * value + int(substring.GEAR[byte])) % 2**32
        if value * substring.MEAN_WORDS >> 32 == 0:
            out.append((tuple(words), start, last))
            start, words = None, []
    if start is not None:
        out.append((tuple(words), start, last))
    return out


def plain_dedup(rows, min_words):
    """Spans that leave each text: rows are (id, text)."""
    chunks = [plain_chunks((t or "").encode()) for _, t in rows]
    owner = {}
    for (i, t), cs in zip(rows, chunks, strict=True):
        if i is not None and t is not None:
            for words, _, _ in cs:
                owner[words] = min(i, owner.get(words, i))
    out = []
    for (i, t), cs in zip(rows, chunks, strict=True):
        seen, spans, run = set(), [], []
        for words, a, b in [*cs, (None, 0, 0)]:
            copy = words is not None and i is not None and t is not None and (words in seen or owner[words] < i)
            seen.add(words)
            if copy:
                run.append((len(words), a, b))
                continue
            if run and sum(r[0] for r in run) >= min_words:
                spans.append((run[0][1], run[-1][2]))
            run = []
        out.append(spans)
    return out


@pytest.mark.parametrize("min_words", [6, 18])
def test_like_the_plain_version(spark, min_words):
    rng = random.Random(4)
    prose = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    passages = [prose(70, 10_000) for _ in range(4)]
    texts = [prose(40, 300) + rng.choice(["\n", "  ", " é "]) + rng.choice(passages) + " " + prose(30, 300) for _ in range(60)]
    texts += [None, "", " \t", "x", texts[3], texts[4] + " tail", passages[0] + "\n" + passages[0], "y" * 500 + " " + passages[1], *[texts[7]] * 5]
    rows = list(enumerate(texts)) + [(None, texts[3]), (2, passages[2]), (2, texts[2])]
    found = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), min_words=min_words).collect()
    key = lambda i, text, spans: (str(i), text or "", text is None, tuple(spans))
    want = []
    for (i, t), spans in zip(rows, plain_dedup(rows, min_words), strict=True):
        raw, kept, at = (t or "").encode(), b"", 0
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        want.append(key(i, None if t is None else ("" if spans and not kept.strip(substring.WHITE_BYTES) else kept.decode()), spans))
    assert sorted(want) == sorted(key(r["doc_id"], r["text"], [(s["start"], s["stop"]) for s in r["removed_spans"]]) for r in found)


def test_very_long_text(spark):
    """More than 2^20 chunks, of which a later copy loses all."""
    words = np.random.default_rng(2).integers(0, 10**6, 2_200_000)
    text = " ".join(map(str, words.tolist()))
    rows = [(1, text + " end"), (2, "short"), (3, text)]
    assert len(substring.chunks_of([text.encode()])["place"]) > 1 << 18
    many = "x " * (1 << 21)  # one word again and again: a copy of itself
    found = {r["doc_id"]: (len(r["text"]), r["n_copied"]) for r in substring.dedup_substrings(spark.createDataFrame([*rows, (4, many)], "doc_id long, text string")).collect()}
    assert found[1][0] >= len(text) * 0.99 and found[2] == (5, 0) and found[3][0] < 200 and found[4][0] < 200
