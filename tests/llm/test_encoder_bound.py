"""Ids stay right when the dictionary's bound drops words."""

from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from strandloom.llm.tokens import WordEncoder, tokenizer_path


@pytest.mark.parametrize("most", [1, 5, 40])
def test_dropped_words(most):
    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(most)
    encoder, whole = WordEncoder(path, most), Tokenizer.from_file(path)
    slices = [[" ".join(f"{chr(97 + rng.randrange(26))}{rng.randrange(90)}" for _ in range(n)) for n in sizes] for sizes in ((200, 3), (2, 4), (1, 1), (30,), (100, 100), (3, 0, 2))]
    slices += [["the cat sat on the mat."], ["a dog, the cat and the mat"]]
    for texts in slices:
        ids, sizes = encoder.encode(texts)
        at = 0
        for text, n in zip(texts, sizes.tolist(), strict=True):
            assert ids[at : at + n].tolist() == whole.encode(text, add_special_tokens=False).ids
            at += n
