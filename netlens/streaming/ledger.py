"""Which record ids are stored: merged intervals, kept with each batch.

A resolver numbers its records, so what one batch stores is a few runs of ids. The ledger
holds these runs, cut at every ``BLOCK`` ids: an id is looked for among the few runs of
its block, whatever time the record claims to be from, and the log is not read at all.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlens.sources.partitions import Folder, finish, replace_partitions

BLOCK = 1 << 20
SCHEMA = "block bigint, low bigint, high bigint, batch bigint"
# Batches that keep entries of their own; older ones are folded into one.
OWN_ENTRIES = 64


def block_of(column: str) -> Column:
    return F.floor(F.col(column) / BLOCK)


def runs(ids: DataFrame, column: str = "record_id") -> DataFrame:
    """(block, low, high) of the ids: gaps and islands inside each block."""
    ids = ids.select(F.col(column).alias("i")).where(F.col("i").isNotNull()).distinct().withColumn("block", block_of("i"))
    order = Window.partitionBy("block").orderBy("i")
    island = F.col("i") - F.row_number().over(order)
    return ids.withColumn("island", island).groupBy("block", "island").agg(F.min("i").alias("low"), F.max("i").alias("high")).drop("island")


def merged(intervals: DataFrame) -> DataFrame:
    """(block, low, high): intervals that touch or overlap are one."""
    order = Window.partitionBy("block").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("low") <= reach + 1, 0).otherwise(1)
    joined = intervals.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("block", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def unstored(rows: DataFrame, ledger: DataFrame, batch: int, column: str = "record_id") -> DataFrame:
    """Rows whose id no other batch has stored. What this batch wrote itself does not count,
    should it run again. Ids meet runs by block: an equi-join."""
    known = ledger.where(F.col("batch") != batch).select(F.col("block").alias("_block"), "low", "high")
    inside = (block_of(column) == F.col("_block")) & F.col(column).between(F.col("low"), F.col("high"))
    return rows.join(known, inside, "left_anti")


def note(ids: DataFrame, path: str, batch: int, column: str = "record_id") -> None:
    """Enter what a batch has stored. Doing it again replaces the entry."""
    finish(ids.sparkSession, path)
    entry = runs(ids, column).withColumn("batch", F.lit(batch).cast("bigint"))
    entry.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def fold(spark: SparkSession, path: str, before: int, at_least: int = OWN_ENTRIES) -> bool:
    """Fold the entries of batches below ``before`` into the last of them, once there are
    ``at_least`` of them. Runs of all history merge to as many as there are gaps."""
    folder = Folder(spark, path)
    names = folder.leaves("", 1) if folder.exists("") else []
    old = sorted(b for b in (int(n.partition("=")[2]) for n in names) if b < before)
    if len(old) < at_least:
        return False
    touched = spark.createDataFrame([(b,) for b in old], "batch bigint")  # a number per folder
    stored = read_ledger(spark, path).where(F.col("batch") < before)
    rows = merged(stored).withColumn("batch", F.lit(old[-1]).cast("bigint"))
    replace_partitions(rows.coalesce(1) if len(old) < 10_000 else rows, path, touched, ("batch",))
    return True
