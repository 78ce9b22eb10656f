"""Counts kept beside the log table, so that health and time series read no log.

For each partition of the log there are its counts by hour, action and direction. They
can be added up, and are made again only for partitions that ingest, a repair, a removal
or a compaction has replaced: whoever changes the table notes the partitions first
(``sources/partitions.py``), and ``refresh`` works off the notes. A refresh that is
interrupted is done again by the next one.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions.scalars import time_bucket, ts_lit
from netlens.operators.filters import TimeWindow
from netlens.operators.stats import HIGH_SCORE, Now, allowed, blocked, firewall
from netlens.sources.partitions import CHANGED, Folder, replace_partitions
from netlens.sources.sinks import PARTITIONS, read_logs

SCHEMA = (
    "log_type string, batch bigint, hour timestamp, rule_action string, direction string, n bigint, threats bigint,"
    " oldest timestamp, latest timestamp, log_date date"
)


def counts_of(logs: DataFrame) -> DataFrame:
    """Counts of log rows by partition, hour, action and direction."""
    hour = F.date_trunc("hour", "timestamp").alias("hour")
    return logs.groupBy("log_date", "log_type", "batch", hour, "rule_action", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("threat_score") > HIGH_SCORE).alias("threats"),
        F.min("timestamp").alias("oldest"), F.max("timestamp").alias("latest"),
    )


def figures_path(path: str) -> str:
    return f"{path.rstrip('/')}_figures"


def read_figures(spark: SparkSession, path: str) -> DataFrame:
    """The counts as of the last ``refresh`` of the log table at ``path``."""
    try:
        return spark.read.schema(SCHEMA).parquet(figures_path(path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def _layout(counts: DataFrame) -> DataFrame:
    # A day has few thousand counts: one file.
    return counts.select(*[c.split()[0] for c in SCHEMA.split(", ")]).repartition("log_date")


def enable(spark: SparkSession, path: str) -> None:
    """Start keeping counts of the log table at ``path``: one pass over it, then changes only."""
    folder = Folder(spark, path)
    # Notes are taken from now on, so a change during the pass is not missed.
    folder.fs.mkdirs(folder.at(CHANGED))
    logs = read_logs(spark, path)
    counts = counts_of(logs)
    counts.transform(_layout).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("log_date").parquet(figures_path(path))


def _partition(name: str) -> dict[str, str]:
    return dict(part.split("=", 1) for part in name.split("/"))


def _same(names: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])


def refresh(spark: SparkSession, path: str) -> int:
    """Bring the counts up to date; gives the number of notes worked off. Reads the changed
    partitions of the log, and the counts of the days they lie in. One at a time, as writers
    of the log are."""
    folder = Folder(spark, path)
    notes = folder.files(CHANGED) if folder.exists(CHANGED) else []
    if not notes:
        return 0
    read = [json.loads(folder.read(f"{CHANGED}/{n}")) for n in notes]
    batches = sorted({r["batch"] for r in read if "batch" in r})
    parts = [_partition(p) for p in sorted({p for r in read for p in r.get("partitions", ())})]
    null = "__HIVE_DEFAULT_PARTITION__"
    # A row per folder changed, as the notes list them.
    rows = [tuple(None if p[c] == null else p[c] for c in PARTITIONS) for p in parts]
    changed = spark.createDataFrame(rows, "a string, t string, b string").select(
        F.col("a").cast("date").alias("_log_date"), F.col("t").alias("_log_type"), F.col("b").cast("bigint").alias("_batch")
    ).where(~F.coalesce(F.col("_batch").isin(batches), F.lit(False)) if batches else F.lit(True))

    def hit(table: DataFrame) -> DataFrame:
        named = table.join(changed, _same(PARTITIONS), "left_semi")
        return named.unionByName(table.where(F.col("batch").isin(batches))) if batches else named

    new = counts_of(hit(read_logs(spark, path))).persist()
    try:
        kept = read_figures(spark, path)
        days = new.select("log_date").unionByName(hit(kept).select("log_date")).distinct().persist()
        same_days = kept.join(days.select(F.col("log_date").alias("_log_date")), _same(("log_date",)), "left_semi")
        stays = same_days.join(changed, _same(PARTITIONS), "left_anti")
        stays = stays.where(~F.coalesce(F.col("batch").isin(batches), F.lit(False))) if batches else stays
        replace_partitions(_layout(stays.unionByName(new.select(*kept.columns))), figures_path(path), days, ("log_date",))
        days.unpersist()
    finally:
        new.unpersist()
    for note in notes:
        folder.delete(f"{CHANGED}/{note}")
    return len(notes)


def in_window(spark: SparkSession, path: str, window: TimeWindow, now: Now) -> DataFrame:
    """Counts that add up to the rows of a time window: whole hours are kept counts, the
    first and the last hour, if cut, are counted from their rows."""
    low, high = window.bounds(now)
    start, hour = ts_lit(low), F.expr("INTERVAL 1 HOUR")
    first = F.when(F.date_trunc("hour", start) == start, start).otherwise(F.date_trunc("hour", start) + hour)
    last = F.date_trunc("hour", ts_lit(high)) if high else None
    figures, logs = read_figures(spark, path), read_logs(spark, path)
    inside = (F.col("log_date") >= F.lit(low[:10]).cast("date")) & (F.col("hour") >= first)
    whole = figures.where(inside & (F.col("hour") < last) if high else inside)
    time = F.col("timestamp")
    cut = window.condition(now, date="log_date")
    # Bounds that let files and row groups be skipped.
    edges = logs.where(cut & (time < first))
    if high:
        edges = edges.unionByName(logs.where(cut & (time >= first) & (time >= last)))
    return whole.unionByName(counts_of(edges).select(*whole.columns))


def _n(condition: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n")) if condition is not None else F.col("n")), F.lit(0))


def health(figures: DataFrame) -> DataFrame:
    return figures.agg(_n().alias("total"), F.min("oldest").alias("oldest"), F.max("latest").alias("latest"))


def counts_for_types(figures: DataFrame, types: tuple[str, ...] = ("wifi", "system")) -> DataFrame:
    return figures.where(F.col("log_type").isin(*types)).agg(*[_n(F.col("log_type") == t).alias(t) for t in types])


def overview(counts: DataFrame) -> DataFrame:
    """The figures of ``stats.overview`` from counts of a window."""
    return counts.agg(
        _n().alias("total"), _n(firewall() & allowed()).alias("allowed"), _n(blocked()).alias("blocked"),
        F.coalesce(F.sum("threats"), F.lit(0)).alias("threats"),
    )


def by_type(counts: DataFrame) -> DataFrame:
    return counts.groupBy("log_type").agg(F.sum("n").alias("count"))


def by_direction(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("direction").isNotNull()).groupBy("direction").agg(F.sum("n").alias("count"))


def _period(window: TimeWindow) -> Column:
    # No preset has periods shorter than an hour.
    return time_bucket("hour", window.normalise().preset).alias("period")


def over_time(counts: DataFrame, window: TimeWindow) -> DataFrame:
    return counts.groupBy(_period(window)).agg(F.sum("n").alias("count"))


def action_over_time(counts: DataFrame, window: TimeWindow) -> DataFrame:
    rows = counts.where(firewall() & F.col("rule_action").isNotNull())
    return rows.groupBy(_period(window)).agg(*[_n(F.col("rule_action") == a).alias(a) for a in ("allow", "block", "redirect")])
