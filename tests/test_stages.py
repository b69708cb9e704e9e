"""Stages of a pipeline: cancellation of siblings, retries, and a record of finished tasks."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from strandloom.plans import etl as E


@pytest.fixture
def registry():
    found = E.Registry()
    tried: list[str] = []

    class Slow(E.Plugin):
        name, tables = "slow", ("slow",)

        def extract(self, spark):
            return spark.range(0, 4, 1, 4).select("id", F.expr("reflect('java.lang.Thread', 'sleep', bigint(90000))").alias("x"))

    class Fails(E.Plugin):
        name, tables = "fails", ("fails",)

        def extract(self, spark):
            tried.append("fails")
            time.sleep(self.params.get("after", 0))
            if len(tried) <= self.params.get("times", 99):
                raise OSError("broken")
            return spark.range(3)

    class Fine(E.Plugin):
        name, tables = "fine", ("fine",)

        def extract(self, spark):
            tried.append("fine")
            return spark.range(self.params.get("n", 3))

    for cls in (Slow, Fails, Fine):
        found.register(cls)
    found.tried = tried
    return found


@pytest.fixture
def store(spark, tmp_path):
    return E.Warehouse(spark, f"file://{tmp_path}/w")


def test_a_failure_stops_its_siblings(store, registry):
    stages = [E.Stage("a", [E.Task("jobs", plugin="slow"), E.Task("process", "SHELL", command="sleep 90"), E.Task("bad", plugin="fails", params={"after": 4})], parallel=True), E.Stage("b", [E.Task("later", plugin="fine")])]
    began = time.time()
    with pytest.raises(OSError, match="broken"):
        E.run_pipeline(stages, store, registry=registry)
    assert time.time() - began < 60 and "fine" not in registry.tried
    assert store.table("slow") is None


def test_retries_are_bounded(store, registry):
    stages = [E.Stage("a", [E.Task("bad", plugin="fails", params={"times": 2})])]
    with pytest.raises(OSError, match="broken"):
        E.run_pipeline(stages, store, registry=registry, retries=1)
    assert E.run_pipeline(stages, store, registry=registry, retries=1) == ["a.bad"] and len(registry.tried) == 3
    assert store.table("fails").count() == 3


def test_resume_leaves_out_finished_tasks(store, registry):
    stages = [E.Stage("a", [E.Task("one", plugin="fine"), E.Task("two", plugin="fine", params={"n": 2})], parallel=True), E.Stage("b", [E.Task("bad", plugin="fails", params={"times": 3}), E.Task("last", "SHELL", command="true")])]
    with pytest.raises(OSError):
        E.run_pipeline(stages, store, registry=registry, pipeline="nightly")
    assert E.finished_tasks(store, "nightly") == {"a.one", "a.two"} and E.finished_tasks(store, "other") == set()
    assert E.run_pipeline(stages, store, registry=registry, pipeline="nightly", resume=True) == ["b.bad", "b.last"]
    assert store.table("fine").count() == 5
    assert E.run_pipeline(stages, store, registry=registry, pipeline="nightly", resume=True) == []
    with pytest.raises(ValueError, match="name"):
        E.run_pipeline(stages, store, registry=registry, resume=True)
