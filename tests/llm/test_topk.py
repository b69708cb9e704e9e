"""Top-k: the bound on lengths, and the pairs of blocks and buckets."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import topk


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("odd", [[1e17, 1.0], [1e300, 0.0], [3e6, 0.0]])
def test_too_long(spark, odd):
    with pytest.raises(Exception, match="too long"):
        topk.top_k(frame(spark, [(0, [1.0, 2.0]), (1, odd)]), F.col("id") == 0).collect()


def test_longest_that_fit(spark):
    x = 2_900_000.0
    rows = topk.top_k(frame(spark, [(0, [x, 0.5]), (1, [x, -0.5]), (2, [-x, 0.25])]), F.col("id") == 0).collect()
    a, b, c = ([int(np.floor(1024 * v)) for v in w] for w in ([x, 0.5], [x, -0.5], [-x, 0.25]))
    dot = lambda p, q: sum(i * j for i, j in zip(p, q, strict=True))
    assert [(r["vec_id"], r["score"]) for r in rows] == [(1, dot(a, b)), (2, dot(a, c))]


def test_blocks_and_buckets(spark, monkeypatch):
    """Every pair of a block and a bucket that is long enough, once; the first buckets are dealt out."""
    blocks = spark.createDataFrame([(k, 2, float(k)) for k in range(6)], "number long, dim int, least_need double")
    buckets = spark.createDataFrame([(2, float(x)) for x in (5, 3, 3, 1)] + [(7, 9.0)], "dim int, longest double")
    found = sorted((r["q_number"], r["rank"]) for r in topk.needed(blocks, buckets).collect())
    assert found == sorted((k, r) for k in range(6) for r, x in enumerate((5, 3, 3, 1)) if x >= k)
    pairs = spark.range(64).select(F.explode(topk.first_ranks(F.col("id"), F.lit(100), F.lit(64))).alias("rank"))
    counts = [r["count"] for r in pairs.groupBy("rank").count().collect()]
    assert sum(counts) == 128 and max(counts) == topk.BLOCKS_OF_A_BUCKET
    assert {r["rank"] for r in spark.range(3).select(F.explode(topk.first_ranks(F.col("id"), F.lit(1), F.lit(3))).alias("rank")).collect()} == {0}
