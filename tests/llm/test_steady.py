"""Which plans give rows the same partitions in every run, and where tables between steps may be."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from strandloom.llm import _shared


def test_steady(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = docs.where("doc_id > 3").select("doc_id", F.upper("text").alias("Exchange Python"))
    assert _shared.steady(plain, "test") is plain  # names say nothing about the plan
    for other in (docs.repartition(3), docs.withColumn("r", F.rand()), docs.groupBy("lang").count(), docs.unionByName(docs)):
        written = _shared.steady(other, "test")
        assert written is not other and written.count() == other.count()


def test_no_folder_of_a_machine_on_a_cluster():
    context = SimpleNamespace(master="local-cluster[2,1,1024]", getConf=lambda: {})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _shared.shared_root(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
