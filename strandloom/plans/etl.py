"""Load plugins, their run ledger, and pipelines of stages and tasks.

A plugin is extract, transform and load over DataFrames. Tables are versioned (operators.versions): what a run writes to all its tables
counts with one version, undo is another version without its rows, and a resumed run leaves out ids that are loaded already. Every run, dry run,
failure and undo is an entry of the log.
"""

from __future__ import annotations

import enum
import json
import re
import shlex
import subprocess
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.versions import Pending, Versions

LEDGER = "run_id string, plugin string, params string, status string, operation string, rows long, seconds double"


class Mode(enum.Enum):
    DRY_RUN = "dry run"
    PREPROCESS = "preprocess"
    RUN = "run"
    UNDO = "undo"


class Plugin:
    """What a loader overrides. tables names its targets, parents first; key is the stable id of a record."""

    name = "plugin"
    version = "1.0"
    description = ""
    tables: tuple[str, ...] = ()
    key = "id"
    batch_size = 5000

    def __init__(self, **params):
        self.params = params

    def extract(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def preprocess(self, spark: SparkSession) -> None:
        """Before a run, in mode PREPROCESS only."""

    def on_run_start(self, store: Warehouse, run_id: str) -> None:
        """Before the rows of a run are extracted."""

    def on_run_complete(self, store: Warehouse, run_id: str, counts: dict[str, int]) -> None:
        """After all tables of a run are written."""

    def on_undo(self, store: Warehouse, run_id: str) -> None:
        """Before the tables of a run are dropped."""

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows

    def load(self, rows: DataFrame) -> dict[str, DataFrame]:
        """Rows by table."""
        return {self.tables[0]: rows}


class Registry:
    """Plugins by name."""

    def __init__(self):
        self.plugins: dict[str, type[Plugin]] = {}

    def register(self, cls: type[Plugin]) -> type[Plugin]:
        if cls.name in self.plugins:
            raise ValueError(f"plugin {cls.name} is registered already")
        self.plugins[cls.name] = cls
        return cls

    def get(self, name: str) -> type[Plugin]:
        if name not in self.plugins:
            raise KeyError(f"no plugin {name}; there are: {', '.join(sorted(self.plugins))}")
        return self.plugins[name]

    def describe(self, name: str) -> dict:
        cls = self.get(name)
        return {"name": cls.name, "version": cls.version, "description": cls.description or (cls.__doc__ or "").strip(), "tables": list(cls.tables)}


REGISTRY = Registry()


class Warehouse:
    """Tables that runs load, and the ledger of runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.versions = Versions(spark, folder)

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """The rows of all runs that count, with their run_id (string)."""
        return self.versions.table(name, version)

    def write(self, pending: Pending, name: str, run_id: str, rows: DataFrame, key: str | None = None, batch_size: int = 0) -> int:
        """Writes the rows of a run; they count once its version is committed."""
        kept = rows.select(*[c for c in rows.columns if c.lower() != "run_id"], F.lit(run_id).alias("run_id"))
        self.versions.write(pending, name, kept, key, max(batch_size, 0) * 200)
        return pending.rows(name)

    def update(self, name: str, changes: DataFrame, key: str) -> dict:
        """New values for the rows whose key comes in changes, in the runs that loaded them."""
        return self.versions.update(name, changes, key)

    def log(self, pending: Pending | None = None, **row) -> int:
        return self.versions.commit(pending or Pending(), {"ledger": row})

    def ledger(self) -> DataFrame:
        rows = self.versions.entries().select("version", F.from_json(F.get_json_object("entry", "$.ledger"), LEDGER).alias("l"))
        return rows.where(F.col("l.run_id").isNotNull()).select("l.*")


def run_plugin(plugin: Plugin, store: Warehouse, mode: Mode = Mode.RUN, resume: bool = False, run_id: str | None = None) -> tuple[str, dict[str, int]]:
    """The run's id and rows by table. resume: records whose key is loaded already are left out. A run id that counts already is refused; one that failed or was undone can come again."""
    about = {"plugin": plugin.name, "params": json.dumps(plugin.params, sort_keys=True, default=str)}
    if mode is Mode.UNDO:
        if not run_id:
            raise ValueError("undo needs a run id")
        plugin.on_undo(store, run_id)
        store.versions.undo(run_id, {"ledger": {"run_id": run_id, **about, "status": "SUCCESS", "operation": "UNDO", "rows": 0, "seconds": 0.0}})
        return run_id, {}
    run_id, began, counts, status, pending = run_id or uuid.uuid4().hex[:12], time.time(), {}, "FAIL", Pending()
    entry = lambda: {"run_id": run_id, **about, "status": status, "operation": mode.name, "rows": sum(counts.values()), "seconds": time.time() - began}
    try:
        if mode is Mode.PREPROCESS:
            plugin.preprocess(store.spark)
        else:
            if mode is Mode.RUN and any(run_id in f["runs"] for files in store.versions.state().files.values() for f in files.values()):
                raise ValueError(f"run {run_id} is loaded already")
            plugin.on_run_start(store, run_id)
            rows = plugin.transform(plugin.extract(store.spark))
            if resume and (loaded := store.table(plugin.tables[0])) is not None and plugin.key in loaded.columns:
                rows = rows.join(loaded.select(plugin.key).distinct(), plugin.key, "left_anti")
            for name, part in plugin.load(rows).items():
                counts[name] = part.count() if mode is Mode.DRY_RUN else store.write(pending, name, run_id, part, plugin.key, plugin.batch_size)
        status = "SUCCESS"
        store.log(pending, **entry())  # all tables of the run count from here on
    except BaseException:
        store.versions.abandon(pending)  # what this call wrote, and nothing else
        status = "FAIL"
        store.log(**entry())
        raise
    if mode in (Mode.RUN, Mode.DRY_RUN):
        try:
            plugin.on_run_complete(store, run_id, counts)
        except Exception:
            if mode is Mode.RUN:
                store.versions.undo(run_id)
            status = "FAIL"
            store.log(**entry())
            raise
    return run_id, counts


def tally(store: Warehouse) -> DataFrame:
    """Runs and rows by plugin and operation; dry runs don't count as rows."""
    rows = F.sum(F.when(F.col("operation") == "RUN", F.col("rows")).otherwise(0))
    return store.ledger().groupBy("plugin", "operation").agg(F.count("*").alias("n_runs"), rows.alias("rows"))


@dataclass
class Task:
    name: str
    type: str = "PLUGIN"
    plugin: str | None = None
    command: str | None = None
    params: dict = field(default_factory=dict)
    skip: bool = False
    deprecated: bool = False


@dataclass
class Stage:
    name: str
    tasks: list[Task]
    parallel: bool = False
    skip: bool = False
    deprecated: bool = False


def interpolate(value, params: dict):
    """`${name}` replaced in strings, lists and dicts; KeyError names what is missing."""
    if isinstance(value, str):
        whole = re.fullmatch(r"\$\{(\w+)\}", value)
        return params[whole[1]] if whole else re.sub(r"\$\{(\w+)\}", lambda m: str(params[m[1]]), value)
    if isinstance(value, dict):
        return {k: interpolate(v, params) for k, v in value.items()}
    return [interpolate(v, params) for v in value] if isinstance(value, list) else value


def deep_merge(left: dict, right: dict) -> dict:
    """right wins, inside nested dicts too."""
    return {k: deep_merge(left[k], right[k]) if isinstance(left.get(k), dict) and isinstance(right.get(k), dict) else right.get(k, left.get(k)) for k in [*left, *(k for k in right if k not in left)]}


def _matches(stage: Stage, task: Task, wanted: str) -> bool:
    return wanted in (stage.name, f"{stage.name}.{task.name}")


def plan(stages: list[Stage], only: list[str] | None = None, skip: list[str] | None = None, resume_at: str | None = None) -> list[tuple[Stage, list[Task]]]:
    """What will run, in order. Names are stages or stage.task; only and skip exclude each other."""
    if only and skip:
        raise ValueError("only and skip exclude each other")
    known = {s.name for s in stages} | {f"{s.name}.{t.name}" for s in stages for t in s.tasks}
    for name in [*(only or []), *(skip or []), *([resume_at] if resume_at else [])]:
        if name not in known:
            raise ValueError(f"no stage or task {name}")
    out, started = [], resume_at is None
    for stage in stages:
        tasks = []
        for task in stage.tasks:
            started = started or _matches(stage, task, resume_at)
            off = stage.skip or stage.deprecated or task.skip or task.deprecated
            chosen = any(_matches(stage, task, n) for n in only) if only else not any(_matches(stage, task, n) for n in skip or [])
            if started and not off and chosen:
                tasks.append(task)
        if tasks:
            out.append((stage, tasks))
    return out


class Cancelled(RuntimeError):
    """A task that was stopped since a sibling failed."""


def finished_tasks(store: Warehouse, pipeline: str) -> set[str]:
    """stage.task names that a pipeline's record has as finished."""
    rows = store.versions.entries().select(F.get_json_object("entry", "$.task.pipeline").alias("p"), F.get_json_object("entry", "$.task.name").alias("name"))
    return {r["name"] for r in rows.where(F.col("p") == pipeline).select("name").distinct().collect()}


class _Running:
    """A task on its way: its Spark jobs carry a tag, its process is known, so both can be stopped."""

    def __init__(self, store: Warehouse, stop: threading.Event):
        self.context, self.stop, self.tag, self.process = store.spark.sparkContext, stop, f"task-{uuid.uuid4().hex}", None

    def shell(self, words: list[str]) -> None:
        self.process = subprocess.Popen(words)
        try:
            while self.process.poll() is None:
                if self.stop.wait(0.05):
                    self.process.kill()
                    self.process.wait()
                    raise Cancelled(words[0])
        finally:
            if self.process.poll() is None:
                self.process.kill()
        if self.process.returncode:
            raise subprocess.CalledProcessError(self.process.returncode, words)

    def cancel(self) -> None:
        self.context.cancelJobsWithTag(self.tag)

    def __enter__(self):
        self.context.addJobTag(self.tag)
        return self

    def __exit__(self, *_):
        self.context.removeJobTag(self.tag)


def run_pipeline(stages: list[Stage], store: Warehouse, params: dict | None = None, registry: Registry = REGISTRY, mode: Mode = Mode.RUN, retries: int = 0, pipeline: str | None = None, resume: bool = False, **selection) -> list[str]:
    """Runs a plan; tasks of a parallel stage are submitted together, and one that fails stops the others: their Spark jobs are cancelled by tag, their processes ended. What fails is tried again so many times.

    pipeline: the name under which finished tasks are recorded in the store's log; with resume those that it has are left out. The names of the tasks that ran, in order of the plan."""
    if resume and not pipeline:
        raise ValueError("resume needs the pipeline's name")
    before = finished_tasks(store, pipeline) if resume else set()
    done: list[str] = []

    def once(task: Task, running: _Running) -> None:
        if task.type == "SHELL":
            words = shlex.split(task.command)  # before parameters are put in, so none of them can add a word or a command
            running.shell([str(interpolate(w, params or {})) for w in words])
        elif task.type == "PLUGIN":
            run_plugin(registry.get(task.plugin)(**interpolate(task.params, params or {})), store, mode)
        else:
            raise NotImplementedError(f"tasks of type {task.type}")

    def one(stage: Stage, task: Task, stop: threading.Event, all_running: list[_Running]) -> str:
        name = f"{stage.name}.{task.name}"
        for left in reversed(range(retries + 1)):
            running = _Running(store, stop)
            all_running.append(running)
            try:
                if stop.is_set():
                    raise Cancelled(name)
                with running:
                    once(task, running)
                break
            except Exception as e:
                if stop.is_set() or isinstance(e, (Cancelled, NotImplementedError, KeyError)):
                    raise
                if not left:
                    stop.set()  # siblings end with this one
                    for other in all_running:
                        if other is not running:
                            other.cancel()
                    raise
        if pipeline and mode is Mode.RUN:
            store.versions.commit(Pending(), {"task": {"pipeline": pipeline, "name": name}})
        return name

    for stage, tasks in plan(stages, **selection):
        tasks = [t for t in tasks if f"{stage.name}.{t.name}" not in before]
        stop, all_running = threading.Event(), []
        if stage.parallel and len(tasks) > 1:
            with ThreadPoolExecutor(len(tasks)) as pool:
                found = [pool.submit(one, stage, t, stop, all_running) for t in tasks]
            errors = [e for f in found if (e := f.exception())]
            # The one that failed by itself, not those that it stopped.
            own = [e for e in errors if not isinstance(e, Cancelled) and "cancelled" not in str(e).lower()]
            if errors:
                raise (own or errors)[0]
            done += [f.result() for f in found]
        else:
            done += [one(stage, t, stop, all_running) for t in tasks]
    return done


def frame_plugin(plugin_name: str, targets: tuple[str, ...], reader: Callable[..., DataFrame], key: str = "id", doc: str = "") -> type[Plugin]:
    """A plugin around a function from (spark, **params) to rows of one table."""

    class FramePlugin(Plugin):
        name, tables, description = plugin_name, targets, doc

        def extract(self, spark: SparkSession) -> DataFrame:
            return reader(spark, **self.params)

    FramePlugin.key = key
    return REGISTRY.register(FramePlugin)


def _register() -> None:
    from strandloom.operators.intervals import bin_tree
    from strandloom.sources import genomic as G
    from strandloom.sources import tables as S

    frame_plugin("gene_models", ("gene",), lambda spark, path: G.gene_models(G.read_gff3(spark, path)), "gene_id", "Genes with transcripts, exons and proteins of a GFF3 file.")
    frame_plugin("gene_annotation", ("go_association",), lambda spark, path: G.evidence_sets(G.read_gaf(spark, path)), "go_id", "Distinct evidence of gene products and terms of a GAF file.")
    frame_plugin("protein_ids", ("protein_xref",), G.read_id_mapping, "uniprot_id", "Protein to Ensembl links.")
    frame_plugin("gene_xrefs", ("xref",), lambda spark, path: G.unpivot_xrefs(G.read_hgnc(spark, path)), "gene_id", "Cross references of the nomenclature file.")
    frame_plugin("pathways_kgml", ("pathway_membership",), G.read_kgml, "pathway_id", "Pathway genes of KGML files.")
    frame_plugin("pathways_tsv", ("pathway_membership",), G.read_reactome, "pathway_id", "Pathway genes of a tab-separated file.")
    frame_plugin("ontology_terms", ("ontology_term",), G.read_owl, "curie", "Classes of an RDF/XML ontology.")
    frame_plugin("external_database", ("external_database",), S.read_json_record, "name", "A source database from a JSON file.")
    frame_plugin("chromosome_map", ("genome_reference",), S.read_chromosome_map, "chromosome", "Contigs and their lengths.")
    frame_plugin("interval_bins", ("interval_bin",), lambda spark, path: bin_tree(spark, [tuple(r) for r in S.read_chromosome_map(spark, path).collect()]), "path", "The bin tree of all contigs.")
    frame_plugin("merge_history", ("ref_snp_alias",), G.read_merges, "ref_snp_id", "Merged reference identifiers.")
    frame_plugin("variants_vcf", ("variant",), lambda spark, path: G.dbsnp_frequencies(G.per_alt(G.read_vcf(spark, path))), "id", "Variants of a VCF, one row for each alternative allele.")
    frame_plugin("xml_records", ("record",), G.read_xml_records, "record", "Generic records of XML files.")
    frame_plugin("track_metadata", ("track",), lambda spark, path: S.read_delimited(spark, path, "\t"), "identifier", "A track-metadata template.")


_register()
