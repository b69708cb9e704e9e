"""Exact tokenisation of whole texts with a vocabulary file of the tokenizers library.

ASCII white space always ends a token in the vocabularies that this module
accepts (white space is dropped by the pre-tokeniser), so a text is split there
and every distinct word is encoded once by the library; a bounded dictionary in
each Python worker keeps the ids. A word that ends in ASCII punctuation after a
letter is looked up in two parts, since the pre-tokeniser splits there too.
Special tokens that stand in a text literally are one id each, as in the library. The
ids equal those of encoding the whole text; tests hold both against each other. A vocabulary file whose normaliser or
pre-tokeniser is another one is used through the library on whole texts.

Defined results: null and empty texts have no ids; a very long text is encoded whole, in a slice of its own; repeated texts
have equal ids, and no ids depend on other texts or on what the dictionary holds. Without texts there are no ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow.compute as pc

from strandloom.llm._shared import let_go

#: The normaliser and the splitting of a vocabulary whose texts can be taken word by word.
_NORMALISER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words kept in a worker unless said otherwise; past it new words are dropped again after their batch.
MOST_WORDS = 400_000
COMMON_WORDS = 2_000
#: No UTF-8 text holds this byte: it stands between documents.
_BETWEEN = b"\xff"
#: Letters before this one are single code points in normal form.
_LATIN_END = "\u0250"
_TAIL = b".,;:!?)]}*#$%&|\""
_LOWER, _WHITE = np.zeros(256, bool), np.zeros(256, bool)
_LOWER[97:123] = True
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _apart(text: bytes) -> bytes:
    """A blank before each full stop or comma that ends a word of letters: the pre-tokeniser splits there."""
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((raw == 44) | (raw == 46))
    at = at[(at > 0) & (at < len(raw) - 1)]
    at = at[_LOWER[raw[at - 1]] & _WHITE[raw[at + 1]]]
    return np.insert(raw, at, 32).tobytes() if len(at) else text


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    """One more than the largest id of this vocabulary file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values()) + 1


def takes_words(path: str) -> bool:
    """Whether texts can be encoded word by word: the file's normaliser and pre-tokeniser are the ones that this module knows."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    normaliser, splitting = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
    first = (splitting.get("pretokenizers") or [{}])[0]
    return [n["type"] for n in normaliser.get("normalizers", [])] == _NORMALISER and first.get("pattern", {}).get("Regex") == _SPLIT and first.get("invert") is True


class WordEncoder:
    """Ids of texts by way of their words."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = takes_words(path)
        self.special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.most = most
        # The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.of_byte = [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {_BETWEEN: 0}
        self.common: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used, self.words = np.zeros(1 << 18, np.int32), 0, 1

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words. One of lower-case Latin letters alone is one pre-token in normal form, so the library's model takes it as it is, byte by byte."""
        out: list[list[int] | None] = []
        rest: list[str] = []
        tokenize = self.tokenizer.model.tokenize
        for word in words:
            text = word.decode("utf-8")
            if word.isalpha():  # A to Z are lower-case by now
                out.append([t.id for t in tokenize(text)])
            elif text.isalpha() and max(text) < _LATIN_END and text == text.lower():
                out.append([t.id for t in tokenize("".join(map(self.of_byte.__getitem__, word)))])
            else:
                out.append(None)
                rest.append(text)
        others = (e.ids for low in range(0, len(rest), 8192) for e in self.tokenizer.encode_batch_fast(rest[low : low + 8192], add_special_tokens=False))
        self.tokenizer.encode_special_tokens = True  # special tokens are taken out of the text before; one that comes of lower-casing is none
        try:
            return [x if x is not None else next(others) for x in out]
        finally:
            self.tokenizer.encode_special_tokens = False

    def _add(self, words: list[bytes]) -> None:
        """Gives new words their places. Heads and tails are encoded once each."""
        heads: dict[bytes, list[int]] = {}
        cut = []
        for w in words:
            head = w.rstrip(_TAIL)
            if head and len(head) < len(w) and head[-1] < 128 and chr(head[-1]).isalpha():
                cut.append((w, head, w[len(head) :]))
            else:
                cut.append((w, w, b""))
        parts = list(dict.fromkeys(p for _, a, b in cut for p in (a, b) if p and p not in self.place))
        heads.update(zip(parts, self._encode(parts), strict=True))
        ids_of = lambda p: heads[p] if p in heads else self.flat[self.starts[self.place[p]] :][: self.sizes[self.place[p]]].tolist()
        new = {p: heads[p] for p in parts}
        for w, a, b in cut:
            if b:
                new[w] = ids_of(a) + ids_of(b)
        count, total = len(new), sum(map(len, new.values()))
        while self.words + count > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        sizes = np.fromiter(map(len, new.values()), np.int64, count)
        self.sizes[self.words : self.words + count] = sizes
        self.starts[self.words : self.words + count] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter((i for x in new.values() for i in x), np.int32, total)
        self.place.update(zip(new, range(self.words, self.words + count)))
        self.words, self.used = self.words + count, self.used + total

    def _around_special(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """encode() where texts hold special tokens literally: the library cuts a text there first, in its own case."""
        cut = [self.cut_special.split(t or "") for t in texts]  # special tokens are at odd places
        ids, sizes = self.encode([x for parts in cut for x in parts[::2]])
        between = iter(np.split(ids, np.cumsum(sizes)[:-1]))
        out = [np.concatenate([np.array([self.special[x]], np.int32) if n % 2 else next(between) for n, x in enumerate(parts)]) for parts in cut]
        return np.concatenate(out), np.array(list(map(len, out)), np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (int32), and how many each has; null is an empty text."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if not self.by_words:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.int32), np.array(list(map(len, found)), np.int64)
        # bytes.lower() touches A to Z only, which the vocabulary's own lower-casing maps alike.
        joined = (b" " + _BETWEEN + b" ").join((t or "").encode("utf-8") for t in texts).lower()
        if any(x.lower().encode("utf-8") in joined for x in self.special) and any(self.cut_special.search(t or "") for t in texts):
            return self._around_special(texts)
        words = _apart(joined).split()
        # Few words make up most of a text: a small dictionary stays in the processor's cache.
        at = np.fromiter(map(self.common.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(at < 0)
        at[rare] = np.fromiter(map(self.place.get, map(words.__getitem__, rare.tolist()), repeat(-1)), np.int64, len(rare))
        new = np.flatnonzero(at < 0).tolist()
        before_words, before_used = self.words, self.used
        if new:
            self._add(list({words[i] for i in new}))
            at[new] = [self.place[words[i]] for i in new]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        if self.words > self.most and new:
            for _ in range(self.words - before_words):
                self.place.popitem()
            self.words, self.used = before_words, before_used
        elif not self.common:  # of words that stay: the places of dropped ones are given anew
            top = np.argsort(-np.bincount(at))[:COMMON_WORDS].tolist()
            names = dict(zip(self.place.values(), self.place, strict=True))
            self.common = {names[k]: k for k in top}
        cuts = np.flatnonzero(at == 0)
        before = np.concatenate([[0], ends[cuts], [total]]) if len(ends) else np.zeros(len(texts) + 1, np.int64)
        return ids, np.diff(before)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, most: int = MOST_WORDS) -> WordEncoder:
    """The worker's encoder of this vocabulary file; one for each file, with the bound that was asked for last."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, most)
    _ENCODERS[path].most = most
    return _ENCODERS[path]


def encoded(batches: Iterator, path: str, text_at: int, bytes_at_once: int = 1 << 20, most: int = MOST_WORDS) -> Iterator:
    """For each slice of a batch: the slice, the ids of its texts in a row, and their numbers."""
    words = encoder(path, most)
    for batch in batches:
        texts = batch.column(text_at)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + bytes_at_once)))
            part = batch.slice(low, high - low)
            yield part, *words.encode(part.column(text_at).to_pylist())
            low = high
        let_go()
