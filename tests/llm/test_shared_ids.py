"""Different texts under one id keep all their links."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from strandloom.llm import jaccard


@pytest.mark.parametrize("swap", [False, True])
def test_two_texts_of_one_id(spark, swap):
    rng = random.Random(1)
    first, second = ([f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(2))
    near = lambda words: " ".join([*words[:-1], "edited"])
    texts = [" ".join(first), " ".join(second)]
    rows = [(5, texts[swap]), (5, texts[not swap]), (8, near(first)), (9, near(second)), (10, "alone in the world with no copy")]
    found = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert Counter((r["id"], r["component_id"]) for r in found) == Counter([(5, 5), (5, 5), (8, 5), (9, 5), (10, 10)])
