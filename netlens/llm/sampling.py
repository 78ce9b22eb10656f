"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import hash_unit


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold of a document."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def per_class(rows: DataFrame, label: str, per_label: int, labels: int, seed: int) -> DataFrame:
    """About ``per_label`` rows (and never more than ``2 * per_label * labels`` in all) of
    each of the ``labels`` most frequent values of ``label``. Whether a row is taken
    depends on its id and text alone; labels are counted over all rows."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), label).limit(labels).collect()
    if not counts:
        return rows.limit(0)
    u = hash_unit(F.lit(seed), F.col("doc_id"), F.col("text"))
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col(label) == F.lit(r[label]), F.lit(per_label / r["c"])).otherwise(rate)
    return rows.where(u < rate).limit(2 * per_label * len(counts))
