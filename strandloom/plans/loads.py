"""Loads: plugins with resume and undo, their ledger, and streams of dropped files."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import rag
from strandloom.plans import etl
from strandloom.plans.registry import Tables, query
from strandloom.staging import new_place
from strandloom.streaming import ingest


class _Frame(etl.Plugin):
    """Loads a frame that it is given."""

    name, tables, key = "customers", ("customer",), "c_custkey"

    def extract(self, spark):
        return self.params["frame"]

    def transform(self, rows):
        return rows.select("c_custkey", "c_name", "c_nationkey")


def _loaded(t: Tables) -> etl.Warehouse:
    """Customers of even nations, then all that are missing, then the first run is undone; and a dry run."""
    store = etl.Warehouse(t.spark, new_place(t.spark, "warehouse"))
    first, _ = etl.run_plugin(_Frame(frame=t.customer.where("c_nationkey % 2 = 0")), store)
    etl.run_plugin(_Frame(frame=t.customer), store, resume=True)
    etl.run_plugin(_Frame(frame=t.customer), store, etl.Mode.DRY_RUN)
    etl.run_plugin(_Frame(), store, etl.Mode.UNDO, run_id=first)
    return store


@query("SELECT c_custkey, c_name FROM customer WHERE NOT (c_nationkey % 2 = 0)")
def load_resume_undo(t: Tables):
    return _loaded(t).table("customer").select("c_custkey", "c_name")


@query("SELECT * FROM (VALUES ('customers', 'DRY_RUN', 1), ('customers', 'UNDO', 1), ('customers', 'RUN', 2)) v(plugin, operation, n_runs), (SELECT count(*) AS n FROM customer) c".replace("SELECT *", "SELECT plugin, operation, n_runs, CASE operation WHEN 'RUN' THEN n ELSE 0 END AS rows"))
def load_ledger(t: Tables):
    return etl.tally(_loaded(t))


def _dropped(t: Tables):
    """Events as files that arrive twice."""
    folder = new_place(t.spark, "dropped")
    events = t.events.select("event_id", "event_type", "user_id", "ts")
    for _ in range(2):
        events.write.mode("append").parquet(folder)
    return ingest.dropped_files(t.spark, folder, "event_id long, event_type string, user_id long, ts timestamp", files_at_once=1000)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_distinct(t: Tables):
    """Each event once, though its file comes twice."""
    out = new_place(t.spark, "stream")
    rows = ingest.distinct_in_bin(_dropped(t), "ts", ["event_id"], "400 days")
    ingest.load_batches(rows, ingest.append_batches(out), new_place(t.spark, "stream-state")).awaitTermination()
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, 2 * count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL 1 DAY, max(ts)) FROM events) GROUP BY 1, 2")
def stream_windows(t: Tables):
    """Counts by day of all days that the last event is past."""
    out = new_place(t.spark, "stream")
    counts = ingest.windowed_counts(_dropped(t), "ts", "event_type", "1 day", "0 seconds")
    ingest.load_batches(counts, ingest.append_batches(out), new_place(t.spark, "stream-state")).awaitTermination()
    return t.spark.read.parquet(out).select(F.col("window.start").alias("day"), "event_type", "n")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_custkey ELSE c_name END AS c_name, c_nationkey FROM customer WHERE NOT (c_nationkey % 2 = 0)")
def load_update(t: Tables):
    """New names for every third customer in a table that runs have loaded."""
    store = _loaded(t)
    changed = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("new "), F.col("c_custkey").cast("string")).alias("c_name"))
    store.update("customer", changed, "c_custkey")
    return store.table("customer").select("c_custkey", "c_name", "c_nationkey")


@query("""
WITH d AS (SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS text FROM nation)
SELECT n_nationkey, 0 AS place, text AS chunk, sha256(text) AS digest, sha256(text) AS whole FROM d""")
def track_chunks(t: Tables):
    """Rows as texts without the fields that are left out, and their chunks."""
    texts = rag.embedded_text(t.nation.select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", ["n_regionkey"])
    rows = rag.chunk_rows(texts, "n_nationkey")
    return rows.join(texts.select("n_nationkey", F.col("digest").alias("whole")), "n_nationkey")


@query("SELECT user_id, event_id // 500 AS bin, count(DISTINCT event_type) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2")
def stream_distinct_by_bin(t: Tables):
    """Types of events of each user, once in each bin of 500 events, from files that come in order."""
    folder, out = new_place(t.spark, "ordered"), new_place(t.spark, "stream")
    t.events.where("user_id IS NOT NULL").select("event_id", "user_id", "event_type").repartitionByRange(4, "event_id").write.parquet(folder)
    stream = ingest.dropped_files(t.spark, folder, "event_id long, user_id long, event_type string", files_at_once=1000)
    rows = ingest.distinct_by_bin(stream, "event_id", ["user_id", "event_type"], 500)
    ingest.load_batches(rows, ingest.append_batches(out), new_place(t.spark, "stream-state")).awaitTermination()
    return t.spark.read.parquet(out).groupBy("user_id", "bin").agg(F.count("*").alias("n"))
