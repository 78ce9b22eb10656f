"""Raw line sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """UTF-8 text (bad bytes replaced), trimmed, without empty lines, as ``raw_log``."""
    if dict(df.dtypes)[column] == "binary":
        text = F.make_valid_utf8(F.col(column).cast("string"))
    else:
        text = F.col(column)
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return df.withColumn("raw_log", trimmed).where(F.col("raw_log") != "").drop(column)


def read_syslog(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the text files under ``path``, once or as a stream."""
    reader = spark.readStream if stream else spark.read
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return clean_lines(reader.text(path))
