"""Language identification with error-correcting output codes.

Every language gets a codeword of bits; one linear classifier for each bit
tells from n-grams of characters' bytes whether the bit is set. The classifiers
look at hashed n-grams of one to three bytes of the text, lower-cased where the
letters are A to Z, white space as one blank: the value of a bit is the mean
weight over the text's n-grams plus a bias. Decoding adds up the logistic
loss of all bits against each codeword, weighted by how well each bit was told on
the training sample, and takes the language with the least. The score is the
share of that language in a softmax over the losses; a prediction is flagged as
ambiguous where the two best are close.

The classifiers are fitted on the driver on a bounded sample: at most
SAMPLE_PER_LANGUAGE rows of each language and SAMPLE_ROWS in all, the first by a hash of the id, of the MOST_LANGUAGES
most frequent languages, each with a text of at most SAMPLE_BYTES bytes (these
are the documented bounds of the fit). Fit and predictions read whole texts.

Defined results: very long texts are predicted from all of their bytes. `und` with score 0 for null texts, texts without a letter, and where
there was nothing to learn from. One learned language is predicted for all
texts with letters. Ties go to the language that sorts first. Repeated rows
get equal predictions; an empty table gives an empty table. Input columns named
like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.substring import slices

BITS = 13
BUCKETS = 1 << BITS
SAMPLE_PER_LANGUAGE = 1_000
SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 1 << 16
MOST_LANGUAGES = 500
STEPS = 150
AMBIGUOUS = 0.2
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def grams(raw: np.ndarray) -> list[np.ndarray]:
    """Buckets of the one-, two- and three-byte windows that start at each byte; the array ends with two blanks."""
    b = _FOLD[raw].astype(np.uint32)
    one, two = b[:-2], (b[:-2] << np.uint32(8)) | b[1:-1]
    three = (two << np.uint32(8)) | b[2:]
    spread = lambda x, salt: ((x + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return [spread(one, 1 << 24), spread(two, 1 << 25), spread(three, 1 << 26)]


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each language: all ways to part few languages in two, random parts that keep rows far apart for more."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1 if k == 0 or not (m >> (k - 1)) & 1 else -1 for k in range(n)] for m in range(1, 1 << (n - 1))]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(seed), max(15, int(np.ceil(10 * np.log2(n))))
    tries = [np.where(rng.random((n, bits)) < 0.5, 1.0, -1.0) for _ in range(200)]
    apart = lambda c: np.min((bits - c @ c.T + 2 * bits * np.eye(n)) / 2) + (np.abs(c.sum(axis=0)) < n).mean()
    return max(tries, key=apart)


class Coder:
    """Fitted weights: one column of buckets for each bit."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.weights, self.bias, self.trust = languages, weights.astype(np.float32), bias, trust
        self.codes = codewords(len(languages))

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Coder:
        """Logistic regression for each bit by accelerated gradient steps on mean n-gram counts."""
        languages = sorted(set(labels))
        codes = codewords(len(languages))
        x = np.zeros((len(texts), BUCKETS), np.float32)
        for k, text in enumerate(texts):
            raw = np.frombuffer(text.encode("utf-8") + b"  ", np.uint8)
            for g in grams(raw):
                x[k] += np.bincount(g, minlength=BUCKETS)
            x[k] /= max(1, x[k].sum())
        scale = np.sqrt((x**2).mean(axis=0)) + 1e-4
        x /= scale
        target = codes[[languages.index(y) for y in labels]].astype(np.float32)
        n = len(texts)
        w, bias = np.zeros((BUCKETS, target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
        ahead, ahead_bias = w.copy(), bias.copy()
        rate = np.float32(4 / max(1e-6, float((x**2).sum(axis=1).mean())))
        for step in range(STEPS):
            pull = -target / (1 + np.exp(np.clip(target * (x @ ahead + ahead_bias), -30, 30)))
            new, new_bias = ahead - rate * (x.T @ pull / n + 1e-4 * ahead), ahead_bias - rate * pull.mean(axis=0)
            k = np.float32(step / (step + 3))
            ahead, ahead_bias = new + k * (new - w), new_bias + k * (new_bias - bias)
            w, bias = new, new_bias
        hit = ((x @ w + bias) * target > 0).mean(axis=0)
        return cls(languages, w / scale[:, None], bias, np.clip(2 * hit - 1, 0.05, 1.0))

    def values(self, texts: list[bytes]) -> np.ndarray:
        """The value of each bit for each text."""
        gap = b"  "
        raw = np.frombuffer(gap.join(texts) + gap, np.uint8)
        sizes = np.array([len(t) + 2 for t in texts], np.int64)
        ends = np.cumsum(sizes)
        starts, lengths = ends - sizes, sizes - 2
        out = np.zeros((len(texts), self.weights.shape[1]))
        there = lengths > 0
        # Windows that start in the gap are left out by zero weights there.
        inside = np.ones(len(raw) - 2, bool)
        for back in (2, 1):
            inside[(ends - back)[ends - back < len(inside)]] = False
        for g in grams(raw):
            for bit in range(out.shape[1]):
                w = self.weights[:, bit][g]
                w[~inside] = 0
                out[there, bit] += np.add.reduceat(w, starts[there], dtype=np.float64) if there.any() else 0
        return out / np.maximum(1, 3 * lengths)[:, None] + self.bias

    def decode(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language's number, its score, and whether a second one is close."""
        loss = (np.logaddexp(0, -values[:, None, :] * self.codes[None]) * self.trust).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ordered = np.sort(share, axis=1)
        second = ordered[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return best, share[np.arange(len(share)), best], ordered[:, -1] - second < AMBIGUOUS


def training_rows(docs: DataFrame, id_col: str, text: str, label: str, where: Column) -> list:
    """The bounded sample: rows of each language that come first by a hash. A share by the count of each language is taken first, so few rows meet for the ranking."""
    rows = docs.where(where & F.col(label).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES) & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LANGUAGES).collect()}
    if not counts:
        return []
    most = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(counts)))
    h = F.xxhash64(id_col)
    share = F.try_element_at(F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4 * most / n))))), F.col(label))
    near = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53) < share
    keys = rows.where(near).select(F.col(label).alias("label"), h.alias("h"), F.col(text).alias("text"))
    order = Window.partitionBy("label").orderBy("h", "text")
    found = keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).collect()
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["label"], r["rank"]))]


def fit(docs: DataFrame, where: Column, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> Coder | None:
    """A coder from the rows where the condition holds; None if there are none."""
    rows = training_rows(docs, id_col, text, label, where)
    return Coder.fit([r[0] for r in rows], [r[1] for r in rows]) if rows else None


def predict(docs: DataFrame, coder: Coder | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous", "lettered_")]
    rows = docs.select(*keep, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered_"))
    fields, text_at = len(keep), keep.index(text)
    shipped = docs.sparkSession.sparkContext.broadcast(coder)  # BUCKETS x bits

    def run(batches):
        coder = shipped.value
        for batch, texts in slices(batches, text_at):
            lettered = batch.column(fields).to_pylist()
            names, scores, close = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            wanted = [k for k, ok in enumerate(lettered) if ok] if coder else []
            if wanted:
                best, share, near = coder.decode(coder.values([texts[k] for k in wanted]))
                scores[wanted], close[wanted] = share, near
                for k, n in zip(wanted, best.tolist(), strict=True):
                    names[k] = coder.languages[n]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(fields)), pa.array(names), pa.array(scores), pa.array(close)], names=[*batch.schema.names[:fields], "lang_pred", "score", "ambiguous"])

    schema = T.StructType([*docs.select(*keep).schema, *T.StructType.fromDDL("lang_pred string, score double, ambiguous boolean")])
    return rows.mapInArrow(run, schema)
