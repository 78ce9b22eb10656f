"""Row-count comparison of two sets of tables after a move."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts(tables: dict[str, DataFrame], out: str) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias(out)).select(F.lit(name).alias("table_name"), out) for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def reconcile_counts(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """Per table: both counts (-1 when missing) and ``mismatch`` when the target
    has fewer rows than a non-empty source."""
    joined = _counts(source, "source_rows").join(_counts(target, "target_rows"), "table_name", "full_outer")
    filled = joined.na.fill(-1, ["source_rows", "target_rows"])
    short = (F.col("source_rows") > 0) & (F.col("target_rows") < F.col("source_rows"))
    return filled.withColumn("status", F.when(short, "mismatch").otherwise("ok"))
