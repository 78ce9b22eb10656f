"""Grouped reports: address pairs, one-dimension aggregates and CIDR roll-ups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.config import NetConfig
from netlens.functions.ip import cidr_of
from netlens.functions.scalars import csv_safe
from netlens.operators.dims import join_names_by_ip
from netlens.operators.filters import LogFilter
from netlens.operators.identity import annotate_identity
from netlens.operators.topk import pick_modal, top_k, with_texts

Now = str | datetime
PAIR_KEYS = ["src_ip", "dst_ip", "dst_port", "protocol"]
GROUP_COLUMNS = {
    "src_ip": "src_ip", "dst_ip": "dst_ip", "country": "geo_country",
    "asn": "asn_name", "rule_name": "rule_name", "service": "service_name",
}
PREFIXES = (8, 16, 22, 24)


def is_allowed() -> Column:
    return F.col("rule_action") == "allow"


def is_blocked() -> Column:
    return F.col("rule_action") == "block"


def _pair_rows(logs: DataFrame, flt: LogFilter, now: Now, cross: Column | None) -> DataFrame:
    rows = flt.apply(logs, now)
    if cross is not None:
        rows = rows.where(cross)
    return rows.where(
        F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
        & F.col("dst_port").isNotNull() & F.col("protocol").isNotNull()
    ).withColumn("protocol", F.lower("protocol"))


def ip_pairs(
    logs: DataFrame, clients: DataFrame, devices: DataFrame, flt: LogFilter, now: Now,
    cfg: NetConfig = NetConfig(), cross: Column | None = None, k: int = 25,
) -> DataFrame:
    """Busiest conversations; names and identities only for the k result rows."""
    if not 1 <= k <= 100:
        raise ValueError("k must be between 1 and 100")
    grouped = with_texts(
        _pair_rows(logs, flt, now, cross), list(PAIR_KEYS), ["service_name", "asn_name", "direction"],
        total_count=(F.count(F.lit(1)), "sum"), allow_count=(F.count_if(is_allowed()), "sum"),
        block_count=(F.count_if(is_blocked()), "sum"), max_threat_score=(F.max("threat_score"), "max"),
    )
    grouped = grouped.select(
        *PAIR_KEYS, "service_name", "total_count", "allow_count", "block_count", "max_threat_score", "asn_name", "direction"
    )
    top = top_k(grouped, k, F.desc("total_count"), *[F.asc(c) for c in PAIR_KEYS])
    named = join_names_by_ip(top, clients, devices, "src_ip", "src_device_name")
    named = join_names_by_ip(named, clients, devices, "dst_ip", "dst_device_name")
    return annotate_identity(named, cfg).orderBy(F.desc("total_count"), *[F.asc(c) for c in PAIR_KEYS])


def ip_pairs_modal(
    logs: DataFrame, flt: LogFilter, now: Now, cross: Column | None = None, k: int = 10_000
) -> DataFrame:
    """Conversations with their most frequent service, for export. Counting per
    service first keeps the state of a hot pair at one row per service."""
    per_service = _pair_rows(logs, flt, now, cross).groupBy(*PAIR_KEYS, "service_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_allowed()).alias("a"),
        F.count_if(is_blocked()).alias("b"),
    )
    pairs = per_service.groupBy(*PAIR_KEYS).agg(
        pick_modal("service_name", "n").alias("service"),
        F.sum("a").alias("allow_count"), F.sum("b").alias("block_count"), F.sum("n").alias("total"),
    )
    top = top_k(pairs, k, F.desc("total"), *[F.asc(c) for c in PAIR_KEYS])
    return top.select(
        F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("destination_ip"),
        F.col("dst_port").alias("port"), "protocol", "service", "allow_count", "block_count",
    )


def ip_pairs_csv(pairs: DataFrame) -> DataFrame:
    return pairs.select(*[csv_safe(c).alias(c) for c in pairs.columns])


def aggregate(
    logs: DataFrame, flt: LogFilter, now: Now, by: str, prefix: int | None = None,
    min_total: int | None = None, min_unique_ips: int | None = None, k: int = 100, approximate: bool = False,
) -> DataFrame:
    """Rows per value of one column, or per network of an address column.

    Distinct counts are exact unless ``approximate`` is chosen: Spark spreads
    them over (group, address), so a hot group is counted by many tasks. The
    modal country and AS hold at most the registered countries and AS names.
    """
    if by not in GROUP_COLUMNS:
        raise ValueError(f"by must be one of {sorted(GROUP_COLUMNS)}")
    if not 1 <= k <= 500:
        raise ValueError("k must be between 1 and 500")
    if prefix is not None and (by not in ("src_ip", "dst_ip") or prefix not in PREFIXES):
        raise ValueError(f"a prefix of {PREFIXES} goes with src_ip or dst_ip")
    if min_unique_ips is not None and by == "src_ip" and prefix is None:
        raise ValueError("min_unique_ips needs a prefix when grouping by src_ip")

    column = GROUP_COLUMNS[by]
    key, name = (F.col(column), column) if prefix is None else (cidr_of(column, prefix), f"{by}_cidr")
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    metrics = [F.count(F.lit(1)).alias("total")]
    if prefix is not None or by != "src_ip":
        metrics.append(distinct(F.col("src_ip")).alias("unique_src_ips"))
    if prefix is not None or by != "dst_ip":
        metrics.append(distinct(F.col("dst_ip")).alias("unique_dst_ips"))
    if prefix is not None:
        metrics += [F.mode("geo_country", True).alias("top_country"), F.mode("asn_name", True).alias("top_asn")]
    rows = flt.apply(logs, now)
    if prefix is not None:
        rows = rows.select(column, "src_ip", "dst_ip", "geo_country", "asn_name", key.alias(name))
        key = F.col(name)
    grouped = rows.groupBy(key.alias(name)).agg(*metrics)
    if min_total is not None:
        grouped = grouped.where(F.col("total") >= min_total)
    if min_unique_ips is not None:
        grouped = grouped.where(F.col("unique_src_ips") >= min_unique_ips)
    return top_k(grouped, k, F.desc("total"), F.asc_nulls_last(name))
