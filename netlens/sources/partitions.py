"""Replacing partitions of a stored table as a whole.

A job that corrects or removes rows says which partitions it has read (``touched``) and
gives all rows that are to be in them. The rows are written beside the table first; then
a list is written of what is to be moved in or emptied; then folders are moved. A job
that dies before the list leaves the table as it was, one that dies after it is finished
by the next writer.

A table that something is derived from has a folder ``CHANGED``: whoever changes it leaves a
note there of the partitions first, so that what is derived can be brought up to date.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Readers of the table skip names that begin with an underscore.
STAGED, READY, CHANGED = "_staged", "_staged_ready.json", "_changed"


class Folder:
    """The few file operations needed, on any file system Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def move(self, old: str, new: str) -> None:
        self.delete(new)
        self.fs.mkdirs(self.at(new.rpartition("/")[0]))
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"can't move {old} to {new} in {self.path}")

    def leaves(self, name: str, depth: int) -> list[str]:
        """Folders ``depth`` levels below ``name``, as paths from there."""
        names = [""]
        for _ in range(depth):
            inner = [(n, s) for n in names for s in (self.fs.listStatus(self.at(f"{name}/{n}".rstrip("/"))) if self.exists(f"{name}/{n}".rstrip("/")) else [])]
            names = [f"{n}/{s.getPath().getName()}".lstrip("/") for n, s in inner if s.isDirectory() and not s.getPath().getName().startswith("_")]
        return names

    def files(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name)) if s.isFile() and not s.getPath().getName().endswith(".part")]

    def write(self, name: str, text: str) -> None:
        # Renamed when complete, so that it is there as a whole or not at all.
        out = self.fs.create(self.at(f"{name}.part"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.move(f"{name}.part", name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text


def folder_name(spark: SparkSession, row, keys: tuple[str, ...]) -> str:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return "/".join(f"{k}={'__HIVE_DEFAULT_PARTITION__' if row[k] is None else escape(str(row[k]))}" for k in keys)


def note_change(folder: Folder, what: dict) -> None:
    """To be called before the change: a note too many costs work, one too few is an error."""
    if folder.exists(CHANGED):
        folder.write(f"{CHANGED}/{uuid.uuid4().hex}", json.dumps(what))


def finish(spark: SparkSession, path: str) -> None:
    """Complete a replacement that was interrupted. Doing it twice does no harm."""
    folder = Folder(spark, path)
    if folder.exists(READY):
        for name, has_rows in json.loads(folder.read(READY)).items():
            if not has_rows:
                folder.delete(name)
            elif folder.exists(f"{STAGED}/{name}"):
                folder.move(f"{STAGED}/{name}", name)
        folder.delete(READY)
    folder.delete(STAGED)


def stage(rows: DataFrame, path: str, touched: DataFrame, keys: tuple[str, ...], rows_per_file: int) -> None:
    """Everything but the last step: the table is still as it was."""
    spark = rows.sparkSession
    finish(spark, path)
    folder = Folder(spark, path)
    rows.write.mode("overwrite").partitionBy(*keys).option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/{STAGED}")
    # One entry per partition: folders are moved by one process, as by any committer.
    names = {folder_name(spark, r, keys): False for r in touched.select(*[F.col(k).cast("string") for k in keys]).distinct().collect()}
    names |= dict.fromkeys(folder.leaves(STAGED, len(keys)), True)
    note_change(folder, {"partitions": sorted(names)})
    folder.write(READY, json.dumps(names))


def replace_partitions(rows: DataFrame, path: str, touched: DataFrame, keys: tuple[str, ...], rows_per_file: int = 2_000_000) -> None:
    """The partitions in ``touched`` and those of ``rows`` hold just ``rows`` afterwards; one
    without rows is gone. ``rows`` may be made from the table itself."""
    stage(rows, path, touched, keys, rows_per_file)
    finish(rows.sparkSession, path)
