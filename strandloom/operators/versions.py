"""Versioned tables: Parquet files, and a log that says which of them count.

A version is one small file in the log, created where nothing stands. It names the files that it adds to and takes from any number of tables,
so what a run writes to several tables appears at once, and a writer that dies leaves files that nothing names. Of two writers of one version the second
reads what the first did and tries the next one, unless both took the same file away, which is a conflict. A reader keeps the files of its version;
`vacuum` deletes those that no version from a given one on names.

Each added file is described by its number of rows, the least and greatest key, and its runs, so an update rewrites only files
that hold changed keys, and undoing a run drops its files and rewrites those that it shares with others. The descriptions are as many as files, and are what the driver holds.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.staging import create_once, file_system

#: Versions between two files that hold the state of all before.
CHECKPOINT_EVERY = 25


class Conflict(RuntimeError):
    """Two writers took the same file away."""


@dataclass
class State:
    """What counts at a version: by table its schema, and its files with their descriptions."""

    version: int = -1
    schemas: dict[str, str] = field(default_factory=dict)
    files: dict[str, dict[str, dict]] = field(default_factory=dict)

    def apply(self, version: int, entry: dict) -> None:
        self.version = version
        for name, schema in entry.get("schemas", {}).items():
            self.schemas[name] = schema
            self.files.setdefault(name, {})
        for name, paths in entry.get("drop", {}).items():
            for path in paths:
                self.files[name].pop(path, None)
        for name, files in entry.get("add", {}).items():
            self.files.setdefault(name, {}).update(files)


@dataclass
class Pending:
    """Files that are written and not named yet."""

    add: dict[str, dict[str, dict]] = field(default_factory=dict)
    drop: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    folders: list[str] = field(default_factory=list)

    def rows(self, name: str) -> int:
        return sum(f["rows"] for f in self.add.get(name, {}).values())


class Versions:
    """Tables below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self) -> dict[str, object]:
        path, fs = file_system(self.spark, f"{self.folder}/_log")
        if not fs.exists(path):
            return {}
        return {s.getPath().getName(): s.getPath() for s in fs.listStatus(path) if s.getPath().getName().endswith((".version", ".state"))}

    def _text(self, path) -> str:
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def state(self, version: int | None = None) -> State:
        """What counts now, or counted at a version."""
        log = self._log()
        inside = lambda n: version is None or n <= version
        numbers = sorted(int(n[:-8]) for n in log if n.endswith(".version") and inside(int(n[:-8])))
        held = [int(n[:-6]) for n in log if n.endswith(".state") and inside(int(n[:-6]))]
        out = State()
        if held:
            last = max(held)
            out = State(last, **json.loads(self._text(log[f"{last:010d}.state"])))
        for n in numbers:
            if n > out.version:
                out.apply(n, json.loads(self._text(log[f"{n:010d}.version"])))
        return out

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """The rows of a table, with the run_id that loaded each; None for a table that no version knows."""
        state = self.state(version)
        if name not in state.schemas:
            return None
        schema = T.StructType.fromJson(json.loads(state.schemas[name]))
        return self._read(schema, sorted(state.files[name]))

    def _read(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        # An explicit schema: nothing is guessed from names, so run ids stay texts.
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def write(self, pending: Pending, name: str, rows: DataFrame, key: str | None, most: int = 0) -> None:
        """Writes rows (with run_id) as new files of a table, of so many rows at most (0: no bound), and describes them. Nothing counts before commit()."""
        folder = f"{name}/{uuid.uuid4().hex}"
        where = f"{self.folder}/data/{folder}"
        pending.folders.append(where)
        rows.write.option("maxRecordsPerFile", most).parquet(where)
        pending.schemas[name] = rows.schema.json()
        written = self.spark.read.schema(rows.schema).parquet(where)
        file = F.col("_metadata.file_name").alias("file")
        merged = written.groupBy(file, "run_id").agg(F.count("*").alias("n")).groupBy("file").agg(F.sum("n").alias("rows"), F.collect_list("run_id").alias("runs"))
        found = {r["file"]: {"rows": r["rows"], "runs": sorted(r["runs"])} for r in merged.collect()}  # a row for each file
        if key in rows.columns:
            ends = written.groupBy(file).agg(F.min(key).alias("low"), F.max(key).alias("high"))
            kind = T.StructType([T.StructField("low", rows.schema[key].dataType), T.StructField("high", rows.schema[key].dataType)])
            for r in ends.select("file", F.to_json(F.struct("low", "high")).alias("range")).collect():
                found[r["file"]] |= {"range": r["range"], "type": kind.json(), "key": key}
        pending.add.setdefault(name, {}).update({f"{folder}/{file}": about for file, about in found.items()})

    def commit(self, pending: Pending, about: dict, base: int | None = None) -> int:
        """Names what is pending in the next free version; its number. base: the version that files to drop were chosen from."""
        version = self.state().version if base is None else base
        entry = {"add": pending.add, "drop": pending.drop, "schemas": pending.schemas, **about}
        while True:
            version += 1
            if create_once(self.spark, f"{self.folder}/_log/{version:010d}.version", json.dumps(entry)):
                break
            state = self.state(version)
            for name, paths in pending.drop.items():
                if gone := [p for p in paths if p not in state.files.get(name, {})]:
                    raise Conflict(f"another writer replaced {len(gone)} files of {name}")
        if version and version % CHECKPOINT_EVERY == 0:
            state = self.state(version)
            create_once(self.spark, f"{self.folder}/_log/{version:010d}.state", json.dumps({"schemas": state.schemas, "files": state.files}))
        return version

    def abandon(self, pending: Pending) -> None:
        """Deletes what this writer wrote and will not name."""
        for where in pending.folders:
            path, fs = file_system(self.spark, where)
            fs.delete(path, True)

    def update(self, name: str, changes: DataFrame, key: str, about: dict | None = None, tries: int = 5) -> dict:
        """New values for the rows whose key comes in changes (once): only files that hold such a key are written anew. How many files of how many were."""
        for left in reversed(range(tries)):
            state, pending = self.state(), Pending()
            schema = T.StructType.fromJson(json.loads(state.schemas[name]))
            files = state.files[name]
            keys = changes.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
            maybe = self._overlapping(files, keys, schema[key])
            hit: list[str] = []
            if maybe:
                rows = self._read(schema, maybe)
                full = {f"{self.folder}/data/{p}".split(":", 1)[-1].lstrip("/"): p for p in maybe}
                found = rows.select("*", F.col("_metadata.file_path").alias("_file")).join(keys, F.col(key) == F.col("_key"), "left_semi").select("_file").distinct().collect()
                hit = sorted(full[r["_file"].split(":", 1)[-1].lstrip("/")] for r in found)
            if hit:
                new = changes.select(F.col(key).alias("_key"), F.struct(*[c for c in changes.columns if c != key]).alias("_new"))
                rows = self._read(schema, hit)
                joined = rows.join(new, rows[key] == new["_key"], "left")
                values = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}").cast(schema[c].dataType)).otherwise(rows[c]).alias(c) if c in changes.columns and c != key else rows[c] for c in rows.columns]
                pending.drop[name] = hit
                self.write(pending, name, joined.select(*values), key)
            try:
                version = self.commit(pending, {"operation": "UPDATE", "table": name, **(about or {})}, state.version)
                return {"version": version, "rewritten": len(hit), "files": len(files)}
            except Conflict:
                self.abandon(pending)
                if not left:
                    raise
        raise AssertionError

    def _overlapping(self, files: dict[str, dict], keys: DataFrame, of: T.StructField) -> list[str]:
        """The files whose range of keys holds a changed key; those without a range too."""
        known = [(p, f["range"]) for p, f in files.items() if "range" in f and f.get("key") == of.name]
        rest = [p for p, f in files.items() if not ("range" in f and f.get("key") == of.name)]
        if not known:
            return rest
        kind = T.StructType([T.StructField("low", of.dataType), T.StructField("high", of.dataType)])
        ranges = self.spark.createDataFrame(known, "path string, range string").select("path", F.from_json("range", kind).alias("r")).select("path", "r.low", "r.high")
        met = keys.join(F.broadcast(ranges), F.col("_key").between(F.col("low"), F.col("high"))).select("path").distinct()  # a row for each file is broadcast
        return sorted(rest + [r["path"] for r in met.collect()])

    def undo(self, run_id: str, about: dict | None = None) -> int:
        """A version without the rows of a run, in all tables at once."""
        while True:
            state, pending = self.state(), Pending()
            for name, files in state.files.items():
                own = [p for p, f in files.items() if f["runs"] == [run_id]]
                shared = [p for p, f in files.items() if run_id in f["runs"] and f["runs"] != [run_id]]
                if own or shared:
                    pending.drop[name] = own + shared
                if shared:
                    schema = T.StructType.fromJson(json.loads(state.schemas[name]))
                    keys = {files[p].get("key") for p in shared}
                    self.write(pending, name, self._read(schema, shared).where(F.col("run_id") != run_id), keys.pop() if len(keys) == 1 else None)
            try:
                return self.commit(pending, {"operation": "UNDO", "run_id": run_id, **(about or {})}, state.version)
            except Conflict:
                self.abandon(pending)

    def entries(self) -> DataFrame:
        """What each version says about itself, as JSON, by version."""
        path = f"{self.folder}/_log"
        if not any(n.endswith(".version") for n in self._log()):
            return self.spark.createDataFrame([], "version long, entry string")
        rows = self.spark.read.option("wholetext", True).option("pathGlobFilter", "*.version").text(path)
        return rows.select(F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long").alias("version"), F.col("value").alias("entry"))

    def vacuum(self, oldest: int) -> int:
        """Deletes files that neither `oldest` nor a later version names, except those newer than the last version, which a writer may be about to name. How many folders went."""
        named: set[str] = set()
        last = self.state().version
        for version in range(max(oldest, 0), last + 1):
            named |= {p.rsplit("/", 1)[0] for files in self.state(version).files.values() for p in files}
        log = self._log()
        newest = max((self._modified(p) for n, p in log.items() if n.endswith(".version")), default=0)
        gone = 0
        top, fs = file_system(self.spark, f"{self.folder}/data")
        for table in fs.listStatus(top) if fs.exists(top) else []:
            for folder in fs.listStatus(table.getPath()):
                inner = f"{table.getPath().getName()}/{folder.getPath().getName()}"
                if inner not in named and folder.getModificationTime() < newest:
                    fs.delete(folder.getPath(), True)
                    gone += 1
        return gone

    def _modified(self, path) -> int:
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
