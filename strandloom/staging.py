"""Tables between the steps of an iterative plan: written to the shared folder and read again, so each step runs once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of our own only where it is unset and one process is all there is."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_strandloom_steps", None) or "file://" + tempfile.mkdtemp(prefix="strandloom-steps-")
        spark.sparkContext._strandloom_steps = root
    return root.rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    """A path below the shared folder for a table or files, which go when the driver's Python ends."""
    where = f"{shared_folder(spark)}/steps/{name}-{uuid.uuid4().hex[:12]}"

    def drop() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone by then
            pass

    atexit.register(drop)
    return where


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    where = new_place(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def text_files(df: DataFrame, name: str) -> str:
    """The path of text files with the lines of df's one column."""
    where = new_place(df.sparkSession, name)
    df.write.text(where)
    return where


def file_system(spark: SparkSession, where: str) -> tuple:
    """Hadoop's path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, where: str, text: str) -> bool:
    """A small file that comes into place whole, or False if there is one. Local file systems link it there, which fails where something stands; others rename at once and only where nothing does."""
    done, fs = file_system(spark, where)
    aside, _ = file_system(spark, f"{where}.{uuid.uuid4().hex}.aside")
    fs.mkdirs(done.getParent())
    out = fs.create(aside, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    jvm, arrays = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), arrays(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(done), local(aside))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(done.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(aside, done, arrays(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return True
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        return False
    finally:
        if fs.exists(aside):
            fs.delete(aside, False)
