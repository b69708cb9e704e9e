"""A vocabulary that splits texts another way is used on whole texts."""

from __future__ import annotations

import numpy as np

from strandloom.llm.tokens import WordEncoder, takes_words, tokenizer_path


def test_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert takes_words(tokenizer_path("word_bpe_49k.json")) and not takes_words(path)
    texts = ["Two  blanks, and\nlines", None, "", "<|endoftext|> Ünï", "x" * 3000]
    ids, sizes = WordEncoder(path).encode(texts)
    library = Tokenizer.from_file(path)
    for part, text in zip(np.split(ids, np.cumsum(sizes)[:-1]), texts, strict=True):
        assert part.tolist() == library.encode(text or "", add_special_tokens=False).ids
