"""Special tokens in a text have the ids that the library gives them by default."""

from __future__ import annotations

from tokenizers import Tokenizer

from strandloom.llm.tokens import WordEncoder, tokenizer_path


def test_special_tokens():
    path = tokenizer_path("word_bpe_49k.json")
    encoder, whole = WordEncoder(path), Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", None, "x<|startoftext|>y.<|endoftext|><|endoftext|>", "<|EndOfText|> A", "", "plain, text.", "<|endoftext|>", "it<|endoftext|>'s e<|endoftext|>\u0301", "<|endof text|>"]
    assert whole.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]
    for slice_ in (texts, texts[:1], texts[3:6], texts[6:7]):
        ids, sizes = encoder.encode(slice_)
        assert ids.dtype == "int32" and len(sizes) == len(slice_)
        at = 0
        for text, n in zip(slice_, sizes.tolist(), strict=True):
            assert ids[at : at + n].tolist() == whole.encode(text or "", add_special_tokens=False).ids, text
            at += n
