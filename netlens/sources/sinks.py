"""Sinks: the partitioned log table, keyed snapshots and CSV files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions.scalars import csv_safe
from netlens.schema import LOG_COLUMNS, conform, ddl
from netlens.sources.partitions import Folder, finish, note_change

# One table for lines, resolver records and repairs. The batch comes last: reports
# prune by date and type, and a batch that runs again replaces only its own files.
PARTITIONS = ("log_date", "log_type", "batch")
STORED = LOG_COLUMNS | {"record_id": "bigint", "batch": "bigint"}
ROWS_PER_FILE = 2_000_000


def laid_out(logs: DataFrame) -> DataFrame:
    """Rows of the log table in its file layout.

    ``rebalance`` gathers each partition's rows but splits a large partition (one
    busy day and type) over many tasks at run time, and merges small ones. Rows
    are sorted by time, so file statistics prune within a day.
    """
    rows = conform(logs, STORED).withColumns(
        {"log_date": F.to_date("timestamp"), "batch": F.coalesce("batch", F.lit(0).cast("bigint"))}
    )
    return rows.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, "timestamp")


def write_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Append, or with ``mode='overwrite'`` replace the partitions the rows are in."""
    (
        laid_out(logs).write.mode(mode).partitionBy(*PARTITIONS)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


RETIRED = "_retired_before"


def retired_before(spark: SparkSession, path: str) -> int:
    """Batches below this number have been merged with others and can't be replaced."""
    folder = Folder(spark, path)
    return int(folder.read(RETIRED)) if folder.exists(RETIRED) else 0


def retire_before(spark: SparkSession, path: str, batch: int) -> None:
    Folder(spark, path).write(RETIRED, str(max(batch, retired_before(spark, path))))


def write_batch(logs: DataFrame, path: str, batch: int) -> bool:
    """Store the rows of one ingest batch. The same batch again replaces its rows; one that
    was merged with others since is recognised, and nothing is written."""
    spark = logs.sparkSession
    finish(spark, path)
    if batch < retired_before(spark, path):
        return False
    note_change(Folder(spark, path), {"batch": batch})
    write_logs(logs.withColumn("batch", F.lit(batch).cast("bigint")), path, mode="overwrite")
    return True


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; empty if nothing was stored yet."""
    stored = {c: kind for c, kind in STORED.items() if c not in PARTITIONS}
    schema = ddl(stored | {"log_date": "date", "log_type": "string", "batch": "bigint"})
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """One complete version of a keyed table. Writing a version again replaces it,
    so a repeated batch does no harm."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str, before: int | None = None) -> DataFrame:
    """The latest version (below ``before``), or an empty table."""
    empty = spark.createDataFrame([], schema)
    try:
        versions = spark.read.schema(T.StructType([*empty.schema, T.StructField("version", T.LongType())])).parquet(path)
    except AnalysisException:
        return empty
    usable = versions if before is None else versions.where(F.col("version") < before)
    latest = usable.agg(F.max("version").alias("v")).first()["v"]  # a single number
    if latest is None:
        return empty
    return versions.where(F.col("version") == latest).drop("version")


def _cell(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind.startswith("array"):
        value = F.when(value.isNotNull(), F.concat(
            F.lit("["), F.array_join(F.transform(value, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]")
        ))
    elif kind == "boolean":
        value = F.initcap(value.cast("string"))
    elif kind == "timestamp":
        value = F.concat(value.cast("string"), F.lit("+00:00"))
    return csv_safe(value).alias(name)


def csv_cells(rows: DataFrame) -> DataFrame:
    """Every column as safe CSV text."""
    return rows.select(*[_cell(name, kind) for name, kind in rows.dtypes])


def write_csv(rows: DataFrame, path: str) -> None:
    csv_cells(rows).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def write_text_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per row (for GeoJSON)."""
    documents.write.mode("overwrite").text(path)
