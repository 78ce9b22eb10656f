"""Helpers of the operators: scratch tables, checked broadcasts, text rules."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these six characters.
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# A side of a join is broadcast only if it was counted and has no more rows.
BROADCAST_ROWS = 200_000


def import_in_workers(spark: SparkSession) -> None:
    """Let the Python workers of a local session find this package where the driver did.
    On a cluster it is installed or shipped with the job."""
    root, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if spark.sparkContext.master.startswith("local") and root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Plans made inside send rows to Python in batches that end once they have ``size``
    bytes; the default counts rows, so there a batch grows with the texts. Spark holds a
    batch and its buffers on the JVM's side too, outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local session
    that names none (tests) gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="netlens-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder, go on from the table written."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/netlens-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished steps once the driver has collected
    the plans that made them, else only every half hour: have it done now."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_checked(big: DataFrame, other: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``other`` broadcast if it was counted to be small; otherwise a shuffle
    join, whose hot partitions adaptive execution splits."""
    return big.join(F.broadcast(other) if small(other, rows) else other, on, how)


def text_of(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def hash_unit(*columns: Column) -> Column:
    """Uniform number inside (0, 1), fixed by the columns' values."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
