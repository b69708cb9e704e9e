"""Byte-level BPE without merging: encoding by longest matches with backtracking, and decoding.

A vocabulary of ranks gives each byte string its id, and merging always takes the pair of least rank,
the leftmost first. The result has a property that makes merging unnecessary: a row of tokens is what
merging would leave if, and only if, each two adjacent ones are what merging leaves of the bytes of both.
So the encoder walks a text from left to right with the longest token that begins at a place, takes it if
it is compatible with the one before, else the next shorter one, and steps back where none is; a place from
which no way led on is never entered again, so work is linear in the text. Bytes are mapped to the Latin-1
characters of the same number, so that the trie of an Aho-Corasick library can hold the tokens and find the longest
one at a place. Compatibility of two tokens follows from how each was merged, and is memoised.

Texts are split by the vocabulary's pattern, and each match is encoded on its own. No match goes past the end
of a run of characters other than white space, so a text is first cut there; ids of short
pieces are kept in a bounded dictionary of each Python worker.

Defined results: a null text is an empty one and has no ids (an empty array); very long texts, and matches, are
encoded whole, in a slice of their own; repeated texts have equal ids, and ties don't arise: the ids of a text
depend on it alone. Null ids decode to null, and an id that the vocabulary lacks, or a null inside of ids, raises an error. Rows
with a null id column are encoded like others. Empty tables give empty tables. Other columns are kept; those
named like an output column (whatever the case) are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandloom.llm._shared import let_go

#: Pieces kept in a worker: those that came first, among which are the frequent ones; others go after their batch.
MOST_PIECES = 400_000
#: Pairs of tokens kept; past it they are found anew.
MOST_PAIRS = 1_000_000
#: Longer pieces are encoded each time they come.
KEPT_LENGTH = 64
BYTES_AT_ONCE = 1 << 20

#: Unicode's white space, as the pattern's own class has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ids from a file of lines with a base64 string and a number."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merged(text: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging leaves of a few bytes, step by step: the definition that the encoder must meet."""
    parts = [text[k : k + 1] for k in range(len(text))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks) + (1 << 32)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class ByteEncoder:
    """Ids of texts under one vocabulary."""

    def __init__(self, path: str, pattern: str, most: int = MOST_PIECES):
        self.ranks = read_ranks(path)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.split = regex.compile(pattern)
        self.most = most
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.length = [len(self.token.get(rank, b"")) for rank in range(max(self.token) + 1)]
        self.pairs: list[dict[int, bool]] = [{} for _ in self.length]
        self.known = 0
        self._parts()
        # Tokens that merging never makes can stand for a whole match alone, which is looked up first.
        self.automaton = ahocorasick.Automaton()
        self.whole = {token.decode("latin-1"): rank for token, rank in self.ranks.items()}
        self.rank_of = {self.token[rank].decode("latin-1"): rank for rank in self.parts}
        for token, rank in self.rank_of.items():
            self.automaton.add_word(token, rank)
        self.longest = max(map(len, self.rank_of))
        self.sizes_of = np.array(self.length, np.int64)
        self.starts_of = np.cumsum(self.sizes_of) - self.sizes_of
        self.bytes_of = np.frombuffer(b"".join(self.token.get(rank, b"") for rank in range(len(self.length))), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def _parts(self) -> None:
        """parts: the two tokens that each token was merged from (None for a byte), for all that merging can make; shorter: the longest token that begins a token and isn't it."""
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * (max(self.token) + 1)
        for rank in sorted(self.token):
            token = self.token[rank]
            if len(token) == 1:
                self.parts[rank] = None
        for rank in sorted(self.token):
            token = self.token[rank]
            for cut in range(len(token) - 1, 0, -1):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is None or right is None or left not in self.parts or right not in self.parts:
                    continue
                if max(left if cut > 1 else -1, right if len(token) - cut > 1 else -1) < rank and self._compatible(left, right):
                    self.parts[rank] = (left, right)
                    self.joined[left, right] = rank
                    break
        for rank in self.parts:
            token = self.token[rank]
            self.shorter[rank] = next((r for cut in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:cut])) in self.parts), -1)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves these two tokens.

        Merging is played back. The facing tokens are undone, the later one first, down to bytes; a token stands from its own
        merge on until the one that took it up. If at any time the facing two could merge before either was taken up, they would
        have; of equal ranks the leftmost goes first, which is the left token's own merge and not the right one's."""
        until_left, until_right = 1 << 62, 1 << 62
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < until_left and across <= until_right:
                return False
            inner_left, inner_right = self.parts[left], self.parts[right]
            if inner_left is None and inner_right is None:
                return True
            if inner_right is None or (inner_left is not None and left > right):
                until_left, left = left, inner_left[1]
            else:
                until_right, right = right, inner_right[0]

    def encode_match(self, text: str) -> list[int]:
        """Ids of one match of the pattern, its bytes mapped to characters."""
        length, shorter, pairs, reach, rank_of, most = self.length, self.shorter, self.pairs, self.automaton.longest_prefix, self.rank_of.get, self.longest
        at, stop, dead = 0, len(text), None
        ids: list[int] = []
        token, fits = -2, None
        while at < stop:
            if token == -2:  # the longest token that begins here
                ahead = text[at : at + most]
                n = reach(ahead)
                token = rank_of(ahead[:n])
                while token is None:
                    n -= 1
                    token = rank_of(ahead[:n])
            while token >= 0:
                if dead is None or at + length[token] not in dead:
                    if fits is None:
                        break
                    known = fits.get(token)
                    if known is None:
                        known = fits[token] = self._compatible(ids[-1], token)
                        self.known += 1
                    if known:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += length[token]
                fits = pairs[token]
                token = -2
            else:
                if dead is None:
                    dead = set()
                dead.add(at)
                token = ids.pop()
                at -= length[token]
                token = shorter[token]
                fits = pairs[ids[-1]] if ids else None
        return ids

    def encode_matches(self, matches: list[str]) -> list[list[int]]:
        """Ids of each match of the pattern."""
        if self.known >= MOST_PAIRS:
            for of in self.pairs:
                of.clear()
            self.known = 0
        out = []
        for match in matches:
            text = match if match.isascii() else match.encode("utf-8").decode("latin-1")
            whole = self.whole.get(text)
            out.append([whole] if whole is not None else self.encode_match(text))
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        cut = list(map(self.split.findall, pieces))
        distinct = dict.fromkeys(chain.from_iterable(cut))
        ids = dict(zip(distinct, self.encode_matches(list(distinct)), strict=True))
        return [ids[of[0]] if len(of) == 1 else [i for m in of for i in ids[m]] for of in cut]

    def _add(self, pieces: list[str]) -> None:
        """Gives new pieces their places."""
        found = self.encode_pieces(pieces)
        count, before = len(pieces), len(self.place)
        sizes = np.fromiter(map(len, found), np.int64, count)
        total = int(sizes.sum())
        while before + count > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.sizes[before : before + count] = sizes
        self.starts[before : before + count] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        self.place.update(zip(pieces, range(before, before + count)))
        self.used += total

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (int32), and how many each has."""
        cut = [_PIECES.findall(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        pieces = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0).tolist()
        before_pieces, before_used = len(self.place), self.used
        if new:
            self._add(list(dict.fromkeys(map(pieces.__getitem__, new))))
            at[new] = [self.place[pieces[k]] for k in new]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        if new and (len(self.place) > self.most or max(map(len, map(pieces.__getitem__, new))) > KEPT_LENGTH):
            for _ in range(len(self.place) - before_pieces):
                self.place.popitem()
            self.used = before_used
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(before)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and how many each has."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes_of) or not self.sizes_of[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        sizes = self.sizes_of[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes_of[np.repeat(self.starts_of[ids] - (ends - sizes), sizes) + np.arange(total)], sizes


_ENCODERS: dict[tuple[str, str], ByteEncoder] = {}


def encoder(path: str, pattern: str) -> ByteEncoder:
    """The worker's encoder of this vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ByteEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose sizes sum to about `most`; a larger row is a slice of its own."""
    ends, low = np.cumsum(sizes), 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most)))
        yield batch.slice(low, high - low)
        low = high


def _without(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c.lower() != name])


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """df with the ids of its texts in a column ids (array of int). vocabulary: the path of a rank file that every executor has."""
    kept = _without(df, "ids")
    at = kept.columns.index(text)

    def run(batches):
        own = encoder(vocabulary, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in _slices(batch, sizes, BYTES_AT_ONCE):
                ids, counts = own.encode(part.column(at).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[*batch.schema.names, "ids"])
            let_go()

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with the bytes of its ids in a column decoded (binary: a slice of a text's ids need not be whole characters)."""
    kept = _without(df, "decoded")
    at = kept.columns.index(ids)

    def run(batches):
        own = encoder(vocabulary, pattern)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in _slices(batch, counts, BYTES_AT_ONCE // 4):
                column = part.column(at)
                flat = column.flatten()
                if flat.null_count:
                    raise ValueError("a null among ids")
                raw, sizes = own.decode(flat.to_numpy(zero_copy_only=False))
                lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])]
                null = column.is_null().to_numpy(zero_copy_only=False)
                valid = None if not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
                out = pa.Array.from_buffers(pa.binary(), part.num_rows, [valid, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*batch.schema.names, "decoded"])
            let_go()

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("decoded", T.BinaryType())]))
