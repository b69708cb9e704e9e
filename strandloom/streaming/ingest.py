"""Structured Streaming: loads of dropped files, deduplication in bins, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dropped_files(spark: SparkSession, folder: str, schema: str, format: str = "parquet", files_at_once: int = 10) -> DataFrame:
    """Rows of files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(format).load(folder)


def distinct_in_bin(rows: DataFrame, time: str, key: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key; state is kept as long as rows may be late."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def distinct_by_bin(rows: DataFrame, place: str, key: list[str], width: int, bins_late: int = 1) -> DataFrame:
    """The first row of each key in each bin of a stream that is about in order of a whole-number place (the same key in another bin stays), with its bin.

    The start of the bin is the stream's clock, a second for each place, so the keys of a bin leave the state once the stream is bins_late bins past it; rows that come later than that are dropped, as
    Spark drops late rows. Over a table it is the same without a state that ends."""
    binned = rows.withColumn("bin", F.floor(F.col(place) / width)).withColumn("bin_time", F.timestamp_seconds((F.col("bin") + 1) * width))  # the clock starts at 0, and what isn't after it is late
    return binned.withWatermark("bin_time", f"{bins_late * width + 1} seconds").dropDuplicates(["bin_time", *key]).drop("bin_time")


def windowed_counts(rows: DataFrame, time: str, by: str, size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))


def load_batches(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Hands each micro-batch with its number to write, which must be idempotent for a number. once: what is there now, then it ends."""
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def append_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """A writer that keeps one folder for each batch number, so a batch that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
