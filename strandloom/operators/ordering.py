"""Places of rows in a total order, without a task that holds a large group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.staging import stage


def places(df: DataFrame, by: list[str], order: list, name: str = "place") -> DataFrame:
    """df with each row's place (from 1) among the rows of its group, which may be as large as the table; by: [] for one group. order must be total.

    Rows are range-partitioned by group and order, so a large group is many tasks; a row's place is its place in its partition and what stands before that. Only a row for each partition, and one for each group, is put in order."""
    keys = [F.col(c) for c in by]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stage(ranged.withColumn("part_", F.spark_partition_id()).withColumn("inside_", inside), "places")
    sizes = rows.groupBy("part_").agg(F.count("*").alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    numbered = rows.join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("inside_") + 1)
    if not by:
        return numbered.select(*df.columns, name)
    # The first place of a group is the rows of the groups before it.
    first = numbered.groupBy(*by).agg(F.min(name).alias("first_"))
    same = numbered.alias("x").join(first.alias("f"), [F.col(f"x.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by])
    return same.select(*[F.col(f"x.{c}") for c in df.columns], (F.col(f"x.{name}") - F.col("first_") + 1).alias(name))
