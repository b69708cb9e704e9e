"""Quality rules: a threshold table compiled into one projection.

Each rule names a measure and the closed interval in which a text passes.
The measures are Column expressions over the words and lines of the whole
text, so a verdict costs one scan and no shuffle; no user function runs.

Defined results: a null or empty text has no words, all counts are 0 and
base_failed is true. A very long text is measured whole. Other columns, repeated rows and ties don't matter;
an empty table gives an empty table. Columns of the input whose names clash
with a measure are replaced in the output by the measure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm._shared import WHITE

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in that is was for it with as on be at by this are from or an a he not"
    " der die das und in zu den von mit ist des im nicht ein eine dem auf sie"
    " le la les de des et en un une du que qui dans est pour par sur au elle"
    " el los las del y se con su para al es una no lo"
).split()

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


#: Columns that judge adds or uses.
OUTPUT = ("word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "_words", "_lines", "_hashes", "_windows", "_pairs", "_starts", "base_failed", "kept")


@dataclass(frozen=True)
class Rule:
    """A measure, and the least and greatest value that pass (None: no bound)."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Bounds follow published web-corpus heuristics, set wide so that plain prose passes.
RULES = (
    Rule("mean_word_length", 2.0, 20.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)


def _counts(text: Column) -> dict[str, Column]:
    length = lambda c: F.coalesce(F.length(c).cast("long"), F.lit(0).cast("long"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    return {
        "word_chars": length(F.translate(text, WHITE, "")),
        "n_symbols": length(text) - length(F.translate(text, SYMBOLS, "")),
        "_words": F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""),
        "_lines": lines,
    }


def _pairs(windows: Column) -> Column:
    """Windows with their places, equal ones side by side; null where no window is found twice."""
    return F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )


def _starts(pairs: Column) -> Column:
    """Where windows start that are found twice or more, ascending. pairs is a plain column: a lambda evaluates what it names again for each element."""
    same = lambda k, j: F.coalesce(F.get(pairs, j)["h"] == F.get(pairs, k)["h"], F.lit(False))
    marked = F.transform(pairs, lambda p, k: F.when(same(k, k - 1) | same(k, k + 1), p["i"]))
    return F.array_sort(F.array_compact(marked))


def _covered(starts: Column) -> Column:
    """Words in the windows that start there, each word once."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"]).cast("long")).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words and n_lines, all long."""
    keep = [c for c in docs.columns if c.lower() not in OUTPUT]
    parts = docs.select(*keep, *(v.alias(k) for k, v in _counts(F.col(text)).items()))
    zero = F.lit(0).cast("long")
    size = lambda c: F.when(F.col(c).isNull(), zero).otherwise(F.size(c).cast("long"))
    hashed = F.transform("_words", lambda w: F.xxhash64(w))
    stops = list(dict.fromkeys(STOP_WORDS))
    hashes = parts.select(
        "*",
        size("_words").alias("n_words"),
        size("_lines").alias("n_lines"),
        F.coalesce((F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), zero).alias("n_dup_lines"),
        F.coalesce(F.size(F.filter("_words", lambda w: F.rtrim(w, F.lit(".,")).isin(stops))).cast("long"), zero).alias("n_stop_words"),
        hashed.alias("_hashes"),
    ).drop("_words", "_lines")
    windows = hashes.select(
        "*",
        F.when(
            F.col("n_words") > WINDOW,
            F.transform(F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW))),
        ).alias("_windows"),
    ).drop("_hashes")
    pairs = windows.select("*", _pairs(F.col("_windows")).alias("_pairs")).drop("_windows")
    starts = pairs.select("*", _starts(F.col("_pairs")).alias("_starts")).drop("_pairs")
    return starts.select("*", F.coalesce(_covered(F.col("_starts")), zero).alias("n_repeat_words")).drop("_starts")


def ratios() -> dict[str, Column]:
    """The measures that rules may name. A ratio over nothing is null, and passes."""
    per = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return {
        "mean_word_length": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One Boolean expression: every rule passes."""
    known, passed = ratios(), F.lit(True)
    for rule in rules:
        value = known[rule.measure]
        if rule.least is not None:
            passed &= F.coalesce(value >= rule.least, F.lit(True))
        if rule.most is not None:
            passed &= F.coalesce(value <= rule.most, F.lit(True))
    return passed


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures, base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    found = measure(docs, text)
    keep = [c for c in found.columns if c.lower() not in ("base_failed", "kept")]
    # Out of a generator of one row: a later filter on kept can't be pushed into the projection, which would compute the measures again for each use.
    verdict = F.array(F.struct(failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept")))
    return found.select(*keep, F.inline(verdict))
