"""Versioned tables: runs, updates and undo, with writers that die, meet or fail."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from strandloom.operators import versions as V
from strandloom.plans import etl as E


class Two(E.Plugin):
    """Loads ids to two tables."""

    name, tables, key = "two", ("parent", "child"), "id"

    def extract(self, spark):
        return spark.range(*self.params["ids"]).select("id", F.concat(F.lit("n"), "id").alias("name"))

    def load(self, rows):
        if self.params.get("fail"):
            return {"parent": rows, "child": rows.where(F.raise_error(F.concat(F.lit("boom"), "name")).isNull())}
        return {"parent": rows, "child": rows.select("id", (F.col("id") * 2).alias("twice"))}


@pytest.fixture
def store(spark, tmp_path):
    return E.Warehouse(spark, f"file://{tmp_path}/w")


def ids(store, name="parent", version=None):
    return sorted(r["id"] for r in store.table(name, version).collect())


def test_a_run_counts_in_all_tables_or_none(store):
    with pytest.raises(Exception, match="boom"):
        E.run_plugin(Two(ids=(0, 5), fail=True), store, run_id="001")
    assert store.table("parent") is None and store.table("child") is None
    E.run_plugin(Two(ids=(0, 5)), store, run_id="001")
    assert ids(store) == ids(store, "child") == list(range(5))
    assert {(r["run_id"], r["status"]) for r in store.ledger().collect()} == {("001", "FAIL"), ("001", "SUCCESS")}
    assert store.table("parent").select("run_id").distinct().collect()[0][0] == "001"


@pytest.mark.parametrize("mode", [E.Mode.DRY_RUN, E.Mode.RUN])
def test_a_failure_under_a_loaded_run_id_keeps_the_run(store, mode):
    E.run_plugin(Two(ids=(0, 5)), store, run_id="7")
    with pytest.raises(Exception, match="boom|loaded already"):
        E.run_plugin(Two(ids=(5, 9), fail=True), store, mode, run_id="7")
    assert ids(store) == ids(store, "child") == list(range(5))


def test_a_writer_that_dies_before_its_version(store, monkeypatch):
    E.run_plugin(Two(ids=(0, 2)), store, run_id="a")
    with monkeypatch.context() as m:
        m.setattr(V.Versions, "abandon", lambda *a: None)  # a killed driver cleans nothing
        m.setattr(V.Versions, "commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            E.run_plugin(Two(ids=(2, 4)), store, run_id="b")
    assert ids(store) == ids(store, "child") == [0, 1]
    E.run_plugin(Two(ids=(2, 4)), store, run_id="b")
    assert ids(store) == [0, 1, 2, 3]
    version = store.versions.state().version
    assert store.versions.vacuum(version) == 2 and ids(store) == [0, 1, 2, 3]


def test_update_with_numeric_run_ids(store):
    for run, low in (("001", 0), ("1", 100), ("2", 200)):
        E.run_plugin(Two(ids=(low, low + 50)), store, run_id=run)
    before = store.table("parent")
    changes = store.spark.createDataFrame([(3, "new"), (140, "other"), (999, "nowhere"), (None, "x")], "id long, name string")
    said = store.update("parent", changes, "id")
    assert 0 < said["rewritten"] <= 2 and said["files"] > 3
    rows = {r["id"]: (r["name"], r["run_id"]) for r in store.table("parent").collect()}
    assert len(rows) == 150 and store.table("parent").count() == 150
    assert rows[3] == ("new", "001") and rows[140] == ("other", "1") and rows[4] == ("n4", "001") and rows[249] == ("n249", "2")
    assert {r["name"] for r in before.collect()} == {f"n{k}" for k in rows}  # a reader keeps its version
    E.run_plugin(Two(), store, E.Mode.UNDO, run_id="1")
    assert ids(store) == ids(store, "child") == [*range(50), *range(200, 250)] and {r["name"] for r in store.table("parent").where("id = 3").collect()} == {"new"}
    assert ids(store, version=2) == [*range(50), *range(100, 150), *range(200, 250)]


def test_undo_of_a_run_that_shares_a_file(store):
    for run, low in (("x", 0), ("y", 10)):
        E.run_plugin(Two(ids=(low, low + 10)), store, run_id=run)
    spark = store.spark
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        store.update("parent", spark.range(20).select("id", F.lit("all").alias("name")), "id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    E.run_plugin(Two(), store, E.Mode.UNDO, run_id="x")
    assert ids(store) == ids(store, "child") == list(range(10, 20)) and {r["name"] for r in store.table("parent").collect()} == {"all"}


def test_writers_at_once(store):
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: E.run_plugin(Two(ids=(10 * k, 10 * k + 10)), E.Warehouse(store.spark, store.folder), run_id=f"r{k}"), range(4)))
    assert ids(store) == ids(store, "child") == list(range(40))
    with ThreadPoolExecutor(3) as pool:
        change = lambda k: store.update("parent", store.spark.createDataFrame([(5, f"by {k}"), (15 + k, "own")], "id long, name string"), "id")
        list(pool.map(change, range(3)))
    rows = {r["id"]: r["name"] for r in store.table("parent").collect()}
    assert len(rows) == 40 and store.table("parent").count() == 40 and rows[5].startswith("by ") and [rows[15 + k] for k in range(3)] == ["own"] * 3


def test_conflicts_and_checkpoints(store, monkeypatch):
    monkeypatch.setattr(V, "CHECKPOINT_EVERY", 3)
    E.run_plugin(Two(ids=(0, 4)), store, run_id="a")
    base = store.versions.state()
    taken = V.Pending(drop={"parent": sorted(base.files["parent"])})
    store.versions.commit(taken, {}, base.version)
    with pytest.raises(V.Conflict):
        store.versions.commit(V.Pending(drop={"parent": sorted(base.files["parent"])}), {}, base.version)
    for k in range(5):
        store.log(run_id=f"dry{k}", plugin="p", params="{}", status="SUCCESS", operation="DRY_RUN", rows=0, seconds=0.0)
    assert ids(store) == [] and ids(store, "child") == [0, 1, 2, 3] and ids(store, version=0) == [0, 1, 2, 3]
    assert any(n.endswith(".state") for n in store.versions._log()) and store.ledger().count() == 6


def test_a_hook_that_fails_after_the_run(store):
    class Hooked(Two):
        def on_run_complete(self, store, run_id, counts):
            raise OSError("hook")

    with pytest.raises(OSError, match="hook"):
        E.run_plugin(Hooked(ids=(0, 3)), store, run_id="h")
    assert ids(store) == []
