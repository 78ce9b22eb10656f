"""Merging the small files that ingest leaves.

Every batch of a stream has a folder of its own in each (date, type). Once batches are
old enough not to run again, their folders are merged: in order of batches, as many as
fit into about ``TARGET_BYTES``. So a (date, type) ends with as many folders as its size
needs, however many batches wrote into it. Which batches are retired is kept with the
table; one that is replayed all the same is recognised and not stored again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlens.sources.partitions import replace_partitions
from netlens.sources.sinks import PARTITIONS, ROWS_PER_FILE, laid_out, read_logs, retire_before, retired_before

TARGET_BYTES = 256 << 20


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(log_date, log_type, batch, files, bytes): from the files' names and lengths; no row is
    read but counted."""
    files = read_logs(spark, path).select(*PARTITIONS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    return files.distinct().groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def bins(folders: DataFrame, before: int, target: int = TARGET_BYTES) -> DataFrame:
    """(log_date, log_type, batch, into): folders of batches below ``before`` that are to be
    merged, and the batch whose name the merged folder takes, its smallest.

    Bins are filled in order of batches by the running sum of lengths, so a bin is at
    most one folder larger than the target, and two neighbours together are no smaller
    than it. A (date, type) has few thousand folders between two runs: one window each.
    """
    old = folders.where(F.col("batch") < before)
    order = Window.partitionBy("log_date", "log_type").orderBy("batch")
    behind = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    old = old.withColumn("bin", F.floor(F.coalesce(behind, F.lit(0)) / F.lit(target)))
    one = Window.partitionBy("log_date", "log_type", "bin")
    merged = old.withColumns({"into": F.min("batch").over(one), "folders": F.count(F.lit(1)).over(one), "all_files": F.sum("files").over(one)})
    several = (F.col("folders") > 1) | ((F.col("all_files") > 1) & (F.col("bytes") < target))
    return merged.where(several).select(*PARTITIONS, "into")


def compact(spark: SparkSession, path: str, before: int, target: int = TARGET_BYTES) -> None:
    """Merge the folders of batches below ``before``, which no stream may run again: the
    current batch of each writer and some before it have to be above. Only folders that
    merge are read. A compaction that is interrupted is finished or repeated."""
    if before <= 0:
        return
    # First of all: from here on a replay of these batches is recognised.
    retire_before(spark, path, before)
    plan = bins(folder_sizes(spark, path), before, target).persist()
    try:
        if plan.isEmpty():
            return
        names = plan.select(*[F.col(c).alias(f"_{c}") for c in PARTITIONS], "into")
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PARTITIONS])
        rows = read_logs(spark, path).join(names, same).withColumn("batch", F.col("into"))
        replace_partitions(laid_out(rows), path, plan.select(*PARTITIONS), PARTITIONS, ROWS_PER_FILE)
    finally:
        plan.unpersist()


__all__ = ["bins", "compact", "folder_sizes", "retired_before"]
