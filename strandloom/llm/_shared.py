"""Helpers that the operators share: tables in the shared folder, and words."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors through Spark, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_strandloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="strandloom-package-")) / "strandloom.zip"  # on the driver, from where Spark serves it
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted((root / "strandloom").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(target))
    context._strandloom_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset and one process is all there is (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_strandloom_root", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="strandloom-")
            spark.sparkContext._strandloom_root = root
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _path(spark: SparkSession, where: str):
    return spark._jvm.org.apache.hadoop.fs.Path(where)


def delete_path(spark: SparkSession, where: str) -> None:
    path = _path(spark, where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, where: str) -> bool:
    path = _path(spark, where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it goes when the driver's Python ends."""
    where = f"{shared_root(spark)}/strandloom/{name}-{uuid.uuid4().hex[:12]}"

    def drop() -> None:
        try:
            delete_path(spark, where)
        except Exception:  # the session may be gone by then
            pass

    atexit.register(drop)
    return where


def staged(df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
    """df written as Parquet to the shared folder and read again: the lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    where = new_folder(spark, name)
    df.write.option("compression", codec).parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._staged_at = where
    return out


def drop_staged(df: DataFrame) -> None:
    """Deletes the table behind a result of staged() that nothing will read again."""
    delete_path(df.sparkSession, df._staged_at)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more, which it else does at its next collection of garbage."""
    gc.collect()
    spark._jvm.System.gc()


def let_go() -> None:
    """Gives what the batches before took back to the system: a worker keeps it otherwise, also while it waits for its next task."""
    pa.default_memory_pool().release_unused()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Texts go to Python by so many rows while the block runs, which must execute what it builds: batches of the default size hold too many long texts at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Nodes of a logical plan that give each partition the same rows in every run.
_STEADY = {"Project", "Filter", "LogicalRelation", "LocalRelation", "Range", "LogicalRDD"}


def steady(df: DataFrame, name: str) -> DataFrame:
    """df itself if all that it does is to read, filter and project, so that rows keep their partitions and places whenever it runs; else staged."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in _STEADY and plan.deterministic():
        below = plan.children()
        if below.isEmpty():
            return df
        plan = below.head()
    return staged(df, name)


def estimated_bytes(df: DataFrame) -> int:
    """The size of df as Spark's own statistics have it; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever the case, one for each given name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
