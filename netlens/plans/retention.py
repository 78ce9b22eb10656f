"""Retention and purge: which rows stay, and how many go."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions.scalars import ts_lit
from netlens.sources.partitions import replace_partitions
from netlens.sources.sinks import PARTITIONS, ROWS_PER_FILE, laid_out, read_logs

Now = str | datetime
GENERAL_DAYS, DNS_DAYS = 60, 10
PURGEABLE = ("wifi", "system")


def parse_days(value) -> int | None:
    try:
        days = int(value)
    except (TypeError, ValueError):
        return None
    return days if days > 0 else None


def resolve_days(configured=None, environment=None, default: int = GENERAL_DAYS) -> tuple[int, str]:
    """(days, where from): configuration, then environment, then default. A bad
    value falls through to the next."""
    for value, source in ((configured, "config"), (environment, "env")):
        days = parse_days(value)
        if days is not None:
            return days, source
    return default, "default"


def _checked(days: int, dns_days: int) -> None:
    for value in (days, dns_days):
        if not isinstance(value, int) or value <= 0:
            raise ValueError(f"retention days must be positive integers, not {value!r}")


def _expired(now: Now, days: int, dns_days: int) -> tuple[Column, Column]:
    def before(n: int) -> Column:
        return F.col("timestamp") < ts_lit(now) - F.expr(f"INTERVAL {n} DAYS")

    is_dns = F.col("log_type") == "dns"
    return is_dns & before(dns_days), ~is_dns & before(days)


def retain(logs: DataFrame, now: Now, days: int = GENERAL_DAYS, dns_days: int = DNS_DAYS) -> DataFrame:
    """Rows that stay. DNS rows have their own, shorter period."""
    _checked(days, dns_days)
    dns, other = _expired(now, days, dns_days)
    return logs.where(~(dns | other))


def retention_counts(logs: DataFrame, now: Now, days: int = GENERAL_DAYS, dns_days: int = DNS_DAYS) -> DataFrame:
    _checked(days, dns_days)
    dns, other = _expired(now, days, dns_days)
    return logs.agg(
        F.count_if(dns).alias("dns_deleted"), F.count_if(other).alias("non_dns_deleted"),
        F.count_if(dns | other).alias("deleted_so_far"),
    )


def droppable_partitions(
    partitions: DataFrame, now: Now, days: int = GENERAL_DAYS, dns_days: int = DNS_DAYS
) -> DataFrame:
    """(log_date, log_type) partitions that expired as a whole. Dropping those
    leaves only the partitions of the two cut-off days to rewrite."""
    _checked(days, dns_days)
    kept = F.when(F.col("log_type") == "dns", dns_days).otherwise(days)
    day_end = F.date_add("log_date", 1).cast("timestamp")
    return partitions.select("log_date", "log_type").distinct().where(
        day_end <= ts_lit(now) - F.make_dt_interval(days=kept)
    )


def purge_snapshot(logs: DataFrame, log_type: str) -> DataFrame:
    """Rows and highest id of a type at the start of a purge."""
    if log_type not in PURGEABLE:
        raise ValueError(f"only {PURGEABLE} can be purged")
    return logs.where(F.col("log_type") == log_type).agg(
        F.count(F.lit(1)).alias("total_rows"), F.max("id").alias("max_id")
    )


def purge(logs: DataFrame, log_type: str, max_id: int) -> DataFrame:
    """All but the type's rows up to the snapshot's id; later rows stay."""
    if log_type not in PURGEABLE:
        raise ValueError(f"only {PURGEABLE} can be purged")
    return logs.where(~((F.col("log_type") == log_type) & (F.col("id") <= max_id)))


def _remove_stored(spark: SparkSession, path: str, gone: Column, whole: DataFrame | None = None) -> None:
    """Take rows out of the stored table: partitions in ``whole`` are emptied unread, others
    that hold such a row are written again without it, or emptied if nothing is left."""
    logs = read_logs(spark, path)
    if whole is not None:
        logs = logs.join(whole, ["log_date", "log_type"], "left_anti")
    gone = F.coalesce(gone, F.lit(False))
    partly = logs.where(gone).select(*PARTITIONS).distinct().persist()
    try:
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PARTITIONS]
        names = partly.select(*[F.col(c).alias(f"_{c}") for c in PARTITIONS])
        kept = logs.join(names, same, "left_semi").where(~gone)
        touched = partly
        if whole is not None:
            parts = read_logs(spark, path).select(*PARTITIONS).distinct()
            touched = partly.unionByName(parts.join(whole, ["log_date", "log_type"], "left_semi").select(*PARTITIONS))
        replace_partitions(laid_out(kept), path, touched, PARTITIONS, ROWS_PER_FILE)
    finally:
        partly.unpersist()


def retain_stored(spark: SparkSession, path: str, now: Now, days: int = GENERAL_DAYS, dns_days: int = DNS_DAYS) -> None:
    """``retain`` on the stored table: only the partitions of the two cut-off days are read."""
    _checked(days, dns_days)
    dns, other = _expired(now, days, dns_days)
    partitions = read_logs(spark, path).select("log_date", "log_type").distinct()
    _remove_stored(spark, path, dns | other, droppable_partitions(partitions, now, days, dns_days))


def purge_stored(spark: SparkSession, path: str, log_type: str, max_id: int) -> None:
    """``purge`` on the stored table; running it again does no harm."""
    if log_type not in PURGEABLE:
        raise ValueError(f"only {PURGEABLE} can be purged")
    _remove_stored(spark, path, (F.col("log_type") == log_type) & (F.col("id") <= max_id))
